"""SQL for DuckDB that gives the rows of those queries whose results have a plain definition."""

import functools

WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

N_GRAM = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4)
      UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM common JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
walk AS (SELECT u AS node, u AS reach FROM e UNION SELECT node, v FROM walk JOIN e ON reach = u),
c AS (SELECT node, min(reach) AS component FROM walk GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
walk AS (SELECT u AS node, u AS reach FROM l UNION SELECT node, v FROM walk JOIN l ON reach = u),
c AS (SELECT node, min(reach) AS component FROM walk GROUP BY node), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON node = vec_id LEFT JOIN n ON u = vec_id"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
late AS (SELECT doc_id, i FROM win JOIN first USING (h) WHERE f < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM late) GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(g, []) AS g FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w) AS n_words, len(g) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, p: NOT list_contains(g, p)), ' ')) AS kept_sha256 FROM k"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(h, {5 * g + 1}, 5) AS INT) >> {s} & 31) + 1, 1)"
    for g in range(8)
    for s in (15, 10, 5, 0)
)
ARCHIVE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT b, min(page_id) AS f FROM p GROUP BY b)
SELECT page_id, octet_length(encode(b)) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM p JOIN f USING (b)"""

_CRC_ROW = [functools.reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(4), k) for k in range(16)]
CRC32 = f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split({{}}, ''), lambda c: [ascii(c) & 15, ascii(c) >> 4]))),
    lambda a, n: xor(a >> 4, CAST({_CRC_ROW} AS BIGINT[])[CAST(xor(a, n) & 15 AS INT) + 1])))"""


def _field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def _climb(name: str, leaves: str, levels: int) -> str:
    """Tables name0 .. name<levels>: g, i, h and, above the first, the parents of runs of 8, until a group has one node."""
    out = [f"{name}0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM {leaves})"]
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
            (any_value(n) + 7) // 8 AS n FROM {name}{k} GROUP BY g, i // 8)""")
    return ",\n".join(out)


def _folds(name: str, start: str, levels: int) -> str:
    """Tables name_f0 ..: what becomes of ``start`` (id, g, i, v, p: node so far, siblings so far) on the way up."""
    out = [f"{name}_f0 AS ({start})"]
    for k in range(levels):
        out.append(f"""{name}_f{k + 1} AS (SELECT id, f.g, f.i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(v) ELSE sha256(string_agg(CASE WHEN t.i = f.i THEN v ELSE h END, '' ORDER BY t.i)) END AS v,
            any_value(p) || coalesce(string_agg(CASE WHEN t.i <> f.i THEN h END, '' ORDER BY t.i), '') AS p
            FROM {name}_f{k} f JOIN {name}{k} t ON t.g = f.g AND t.i // 8 = f.i // 8 GROUP BY id, f.g, f.i)""")
    return ",\n".join(out)


_UP, _OVER = 7, 3  # levels for up to 2 million rows of a language and 512 languages


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MANIFEST = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS g, {_leaf("text")} AS h,
           CASE WHEN {CRC32.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf(_SMALL)} END AS told FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h, told, id) - 1 AS i FROM d),
{_climb("t", "r", _UP)},
sub AS (SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, h, g AS of FROM t{_UP}),
{_climb("s", "sub", _OVER)},
{_folds("t", "SELECT id, g, i, coalesce(told, h) AS v, '' AS p FROM r", _UP)},
{_folds("s", f"SELECT f.id, '' AS g, sub.i, v, p FROM t_f{_UP} f JOIN sub ON f.g = sub.of", _OVER)}
SELECT doc_id, r.h AS leaf, sub.h AS subroot, root.h AS root, sha256(p) AS proof_sha256, v AS folded_root, v = root.h AS verified
FROM r JOIN sub ON r.g = sub.of JOIN s_f{_OVER} f ON f.id = r.id CROSS JOIN s{_OVER} root"""

BYTES = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT k, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT k, x, unnest(range(0, CAST(len(x) / 2 AS BIGINT) - 399)) AS i FROM d WHERE len(x) >= 800)),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM win SEMI JOIN again USING (h)),
run AS (SELECT k, i, sum(CASE WHEN i - before <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run FROM hit),
span AS (SELECT k, run, min(i) AS a, max(i) + 400 AS b FROM run GROUP BY k, run),
cut AS (SELECT k, run, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY run), 0) AS free FROM span),
kept AS (SELECT k, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * free + 1, 2 * (a - free)), '' ORDER BY run) AS kept, max(b) AS tail
         FROM cut JOIN d USING (k) GROUP BY k)
SELECT doc_id, CAST(len(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (k)"""

TARGETS = f"""
WITH d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size FROM documents),
s AS (SELECT source, sum(size) AS s, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS k FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][(k - 1) % 3 + 1] AS w FROM s),
o AS (SELECT *, 2.0 * s / w AS ratio, sum(2.0 * s) OVER below - 2.0 * s AS held, sum(w) OVER () - sum(w) OVER below + w AS rest, 1.5 * sum(s) OVER () AS total
      FROM w WINDOW below AS (ORDER BY 2.0 * s / w, k)),
level AS (SELECT arg_min((total - held) / rest, ratio) FILTER (WHERE (total - held) / rest <= ratio) AS level FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(s AS BIGINT) AS source_size, round(least(2.0 * s, coalesce(level, 1e300) * w), 4) AS target
FROM d JOIN o ON o.source IS NOT DISTINCT FROM d.source CROSS JOIN level"""

CRC32_BYTES = f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(0, len(h) // 2), lambda i: [h[2 * i + 2], h[2 * i + 1]]))),
    lambda a, n: xor(a >> 4, CAST({_CRC_ROW} AS BIGINT[])[CAST(xor(a, n) & 15 AS INT) + 1])))"""
SIZES = f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(list_filter(string_split(hex(encode(coalesce(text, ''))), ''), lambda c: c <> ''), lambda c: CAST(strpos('0123456789ABCDEF', c) - 1 AS BIGINT)) AS h FROM documents)
SELECT doc_id, CAST(size AS BIGINT) AS size, CASE WHEN len(h) = 0 THEN 0 ELSE {CRC32_BYTES} END AS text_crc32, true AS together, true AS gapless, true AS level FROM d"""

LANGUAGES = f"""
SELECT doc_id, {CRC32.format("CAST(doc_id AS VARCHAR)")} % 3 = 1 AS held_out, NOT regexp_matches(coalesce(text, ''), '\\p{{L}}') AS undecided, true AS in_range FROM documents"""

SECRETS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda s: length(s) >= 8)) AS n_assign,
       len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda s: length(s) >= 16)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda s: length(s) >= 32)) AS n_hex FROM d"""

ORACLE_SQL = {
    "mix_targets": TARGETS,
    "shard_laws": SIZES,
    "language_laws": LANGUAGES,
    "secret_counts": SECRETS,
    "op5_ngram_jaccard": N_GRAM,
    "op7_embedding_near_dedup": EMBEDDINGS,
    "op9_substring_dedup": SUBSTRINGS,
    "op10_warc_archive": ARCHIVE,
    "op12_merkle_manifest": MANIFEST,
    "op13_suffix_array_dedup": BYTES,
}
