"""Operators that prepare text corpora for language-model training.

Nothing else in ``lumitide`` imports this subpackage.  Shared conventions:

* a *word* is a maximal run of letters, digits and marks of the lower-cased text
  (:mod:`.tokens`); positions are word indices, never byte offsets;
* every operator selects the columns it needs by name, so extra columns, whatever
  they are called, do not matter;
* a null text is an empty text; rows without an id take part in corpus statistics
  but can't be named in a result.
"""
