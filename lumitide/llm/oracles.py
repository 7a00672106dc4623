"""DuckDB SQL for the queries that SQL can express.

Operator 3 is approximate; its SQL compares all texts that share a run of three words and follows the pairs to their groups.
Operator 4's scores all passages against all units; operator 6's compares the texts of all runs of 50 words.  Operator 10 is approximate; its SQL compares all pairs and follows them to their groups.
"""

from __future__ import annotations


def words(text: str = "text") -> str:
    """The words of the lower-cased text, as :mod:`.tokens` splits them."""
    return rf"regexp_extract_all(lower(coalesce({text}, '')), '[\x{{3040}}-\x{{9FFF}}]|[0-9a-z\x{{C0}}-\x{{1FFF}}\x{{2080}}-\x{{2FFF}}\x{{A000}}-\x{{10FFFF}}]+')"


def _grams(words: str, n: str) -> str:
    return f"list_distinct(list_transform(range(len({words}) - ({n}) + 1), lambda i: array_to_string({words}[i + 1 : i + ({n})], ' ')))"


def _licenses() -> str:
    from .licenses import SPDX, TEMPLATES, spelled

    text = lambda ws: "['" + "', '".join(ws) + "']"
    templates = ", ".join(f"({k}, '{name}', {text(spelled(notice))}, [{', '.join(text(spelled(p)) for p in phrases)}])" for k, (name, notice, phrases) in enumerate(TEMPLATES))
    known = ", ".join(f"('{name}', {text(spelled(x))})" for name, x in SPDX)
    return f"""WITH RECURSIVE tp AS (SELECT t, name, tw, len(tw) AS size, ph, ph[1] AS f, len(ph[1]) AS fl, list_filter(range(len(tw)), lambda i: tw[i + 1 : i + len(ph[1])] = ph[1])[1] AS off FROM (VALUES {templates}) AS v(t, name, tw, ph)),
sp AS (SELECT name, x, len(x) AS k FROM (VALUES {known}) AS v(name, x)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words()} AS w FROM documents),
df AS (SELECT x, count(*) AS n FROM (SELECT DISTINCT r, unnest(w) AS x FROM d) GROUP BY x),
an AS (SELECT t, x FROM (SELECT t, x, row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), x) AS rank FROM (SELECT DISTINCT t, unnest(tw) AS x FROM tp) LEFT JOIN df USING (x)) WHERE rank <= 4),
need AS (SELECT t, CAST(greatest(1, ceil(count(*) * 0.5)) AS BIGINT) AS need FROM an GROUP BY t),
post AS (SELECT t, x, q FROM (SELECT t, unnest(tw) AS x, unnest(range(size)) AS q FROM tp) JOIN an USING (t, x)),
wo AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS p FROM d WHERE doc_id IS NOT NULL),
pl AS (SELECT wo.r, t, name, wo.p AS place, wo.p - off AS shift, size, fl, tw, list_slice(w, greatest(0, wo.p - off - 3) + 1, wo.p - off + size + 3) AS st, ph FROM wo JOIN tp ON wo.x = f[1] JOIN d ON wo.r = d.r WHERE d.w[wo.p + 1 : wo.p + fl] = f),
nr AS (SELECT r, t, place, x, arg_min(p, (abs(p - q - shift), p - q, p)) AS p FROM (SELECT pl.r, pl.t, place, shift, post.x, wo.p, q FROM pl JOIN post ON pl.t = post.t JOIN wo ON wo.r = pl.r AND wo.x = post.x AND abs(wo.p - q - shift) <= 3) GROUP BY ALL),
ag AS (SELECT r, t, place, count(*) AS anchors, min(p) AS lo, max(p) + 1 AS hi FROM nr GROUP BY ALL),
ok AS (SELECT pl.r, name, greatest(0, shift) AS position, anchors, len(list_filter(list_distinct(tw), lambda x: list_contains(st, x))) / CAST(len(list_distinct(tw)) AS DOUBLE) AS share, size, least(pl.place, lo) AS b, greatest(pl.place + fl, hi) AS e FROM pl JOIN ag ON ag.r = pl.r AND ag.t = pl.t AND ag.place = pl.place JOIN need ON need.t = pl.t
  WHERE anchors >= need AND len(list_filter(ph, lambda p: len(list_filter(range(len(st)), lambda i: st[i + 1 : i + len(p)] = p)) = 0)) = 0),
ex AS (SELECT wo.r, wo.p + 3 AS i FROM wo JOIN d ON wo.r = d.r WHERE wo.x = 'spdx' AND d.w[wo.p + 1 : wo.p + 3] = ['spdx', 'license', 'identifier']
  UNION ALL SELECT r, j + step FROM (SELECT r, j, list_filter(range(1, CASE WHEN k = 0 OR w[j + 1] = 'with' THEN 7 ELSE 2 END), lambda s: w[j + s] IN ('or', 'and'))[1] AS step
    FROM (SELECT r, w, k, i + k + CASE WHEN k = 0 THEN 0 WHEN w[i + k + 1 : i + k + 2] = ['or', 'later'] THEN 2 WHEN w[i + k + 1] = 'only' THEN 1 ELSE 0 END AS j
      FROM (SELECT ex.r, ex.i, d.w, coalesce((SELECT max(k) FROM sp WHERE d.w[ex.i + 1 : ex.i + k] = x), 0) AS k FROM ex JOIN d ON ex.r = d.r))) WHERE step IS NOT NULL),
hit AS (SELECT r, name, position, anchors, share, size, b, e FROM ok UNION ALL SELECT r, name, i, 3 + k, 1e0, k, i, i + k FROM (SELECT DISTINCT ex.r, ex.i, arg_max(sp.name, k) AS name, max(k) AS k FROM ex JOIN d ON ex.r = d.r JOIN sp ON d.w[ex.i + 1 : ex.i + k] = x GROUP BY ex.r, ex.i)),
rk AS (SELECT *, row_number() OVER (PARTITION BY r, name ORDER BY share * size DESC, position, anchors DESC, b) AS nth FROM hit),
go AS (SELECT r, name, nth, [[b, e]] AS taken, true AS kept FROM rk WHERE nth = 1
  UNION ALL SELECT r, name, nth, CASE WHEN free THEN list_append(taken, [b, e]) ELSE taken END, free FROM (SELECT rk.r, rk.name, rk.nth, taken, b, e, len(list_filter(taken, lambda s: s[1] < e AND b < s[2])) = 0 AS free FROM go JOIN rk ON go.r = rk.r AND go.name = rk.name AND rk.nth = go.nth + 1))
SELECT doc_id, rk.name AS license, position, CAST(anchors AS INTEGER) AS anchors, share FROM go JOIN rk ON go.r = rk.r AND go.name = rk.name AND go.nth = rk.nth JOIN d ON d.r = rk.r WHERE kept"""


ORACLES: dict[str, str] = {
    "op3_minhash_bayes": f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {words()} AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT r, doc_id, hash(g) AS g FROM (SELECT r, doc_id, unnest({_grams("w", "least(3, len(w))")}) AS g FROM w WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
b AS (SELECT s.r AS r, t.r AS q, s.doc_id AS x, t.doc_id AS y, count(*) AS k FROM s JOIN s t ON s.g = t.g AND s.r < t.r GROUP BY ALL),
p AS (SELECT DISTINCT x, y FROM b JOIN n ON b.r = n.r JOIN n m ON b.q = m.r WHERE x <> y AND k >= 0.5 * (n.n + m.n - k)),
e AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
c AS (SELECT x, x AS y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x)
SELECT x AS doc_id, min(y) AS group_id, count(*) AS group_size, x = min(y) AS keep FROM c GROUP BY x""",
    "op4_bm25_decontamination": f"""WITH b AS (SELECT row_number() OVER (ORDER BY item_id, text) AS k, item_id, {words()} AS w,
  list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: len({words("x")})), lambda n: n > 0) AS parts FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT k, item_id, w, len(w) AS n, CASE WHEN len(parts) > 1 THEN parts[-1] ELSE greatest(1, len(w) // 5) END AS na FROM b WHERE len(w) > 0),
unit AS (SELECT k, s AS u, w[s + 1 : s + 64] AS uw FROM (SELECT k, w, unnest(CASE WHEN n < 64 THEN [0] ELSE list_distinct(list_append(list_transform(range(n // 64), lambda x: x * 64), n - 64)) END) AS s FROM i)),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS n_units, avg(len(uw)) AS mean FROM unit),
tf AS (SELECT k, u, t, size, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT k, u, len(uw) AS size, unnest(uw) AS t FROM unit) GROUP BY ALL),
df AS (SELECT t, count(*) AS d FROM tf GROUP BY t),
wt AS (SELECT k, u, t, ln(1 + (n_units - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) AS x FROM tf JOIN df USING (t), tot),
imp AS (SELECT k, u, t, x / sum(x) OVER (PARTITION BY k, u) AS v FROM wt),
d AS (SELECT row_number() OVER () AS r, doc_id, {words()} AS w FROM documents WHERE doc_id IS NOT NULL),
pt AS (SELECT DISTINCT r, p, unnest(w[p * 64 + 1 : p * 64 + 128]) AS t FROM (SELECT r, w, unnest(range((len(w) + 63) // 64)) AS p FROM d)),
hit AS (SELECT r, p, k, max(s) AS s FROM (SELECT r, p, k, u, sum(v) AS s FROM pt JOIN imp USING (t) GROUP BY ALL) WHERE s >= 0.6 - 1e-9 GROUP BY ALL),
cut AS (SELECT r, k, p, s, n, coalesce((p - lag(p) OVER (PARTITION BY r, k ORDER BY p)) * 64 > 128 + 2 * n, false) AS cut FROM hit JOIN i USING (k)),
reg AS (SELECT r, k, n, g, min(p) * 64 - n AS b, (max(p) + 2) * 64 + n AS e, max(s) AS s FROM (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY r, k ORDER BY p) AS g FROM cut) GROUP BY r, k, n, g),
h AS (SELECT doc_id, item_id, s, d.w[greatest(b, 0) + 1 : e] AS z, i.w[1 : i.n - na] AS q, i.w[i.n - na + 1 : i.n] AS a FROM reg JOIN d USING (r) JOIN i USING (k)),
sh AS (SELECT doc_id, item_id, s, CASE WHEN len(q) = 0 THEN 1.0 ELSE len(list_intersect({_grams("q", "least(5, len(q))")}, {_grams("z", "least(5, len(q))")})) / len({_grams("q", "least(5, len(q))")}) END AS qs,
  CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_intersect({_grams("a", "least(3, len(a))")}, {_grams("z", "least(3, len(a))")})) / len({_grams("a", "least(3, len(a))")}) END AS sa FROM h)
SELECT doc_id, item_id, round(max(s), 6) AS score, round(max(qs), 6) AS question_overlap, round(max(sa), 6) AS answer_overlap FROM sh WHERE qs >= 0.7 AND sa >= 0.7 GROUP BY doc_id, item_id""",
    "op6_sparse_suffix_dedup": f"""WITH w AS (SELECT doc_id, {words()} AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM w WHERE len(w) >= 50)),
hit AS (SELECT DISTINCT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING min(doc_id) < max(doc_id))),
run AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM hit)
SELECT doc_id, min(i) AS start_word, max(i) + 50 AS end_word, max(i) + 50 - min(i) AS n_words FROM run GROUP BY doc_id, island""",
    "op10_pstable_embeddings": """WITH RECURSIVE u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95e0),
r AS (SELECT x, x AS y FROM p UNION SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
SELECT x AS vec_id, min(y) AS group_id, count(*) AS group_size, x = min(y) AS keep FROM r GROUP BY x""",
}
ORACLES["op5_license_scan"] = _licenses()
