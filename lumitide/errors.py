"""Errors of plans, graphs and parameters, each with a stable code."""

from __future__ import annotations


class EngineError(ValueError):
    code = "MESSAGE"

    def __str__(self) -> str:
        return f"[LT_{self.code}] {super().__str__()}"


class ParamError(EngineError):
    code = "INVALID_PARAMS"


class UnknownId(EngineError):
    code = "UNKNOWN_ID"


class CycleError(EngineError):
    code = "CYCLE"


class UnknownOperation(EngineError):
    code = "UNKNOWN_OPERATION"


class DuplicateNode(EngineError):
    code = "DUPLICATE_NODE_ID"


class DuplicateAsset(EngineError):
    code = "DUPLICATE_ASSET_ID"


class DuplicateOutput(EngineError):
    code = "DUPLICATE_OUTPUT_NAME"


class NotExecutable(EngineError):
    code = "NOT_EXECUTABLE"


class ContractError(EngineError):
    code = "MEDIA_CONTRACT"


class MediaError(EngineError):
    code = "MEDIA"


class Cancelled(EngineError):
    code = "CANCELLED"
