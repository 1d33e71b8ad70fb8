"""The numbered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import idfile, warc
from .data import read
from .jaccard import similar_documents
from .licenses import BASE, LOWER, UPPER, WEIGHTS, find_licenses
from .licenses import rules as license_rules
from .lines import dedup_lines
from .merkle import FIELDS, manifest
from .packing import pack
from .periodic import find_runs
from .quality import LEFT_PERCENT, MIN_DOCS, MIN_WORDS, quality
from .scratch import Scratch
from .secrets import RULES, commit, digest
from .toxicity import toxicity
from .urls import filter_urls
from .winnow import contamination

#: A-Z to a-z in SQL, other letters as they are.
SQL_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), with_ids=False)


def op10_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, folder = tokenizer("word_bpe_49k.json"), Scratch(spark, "token-ids").base
    manifest = idfile.write(read(spark, sf_dir, "documents"), path, folder)
    return idfile.read(manifest, folder, path, with_ids=False)


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses(read(spark, sf_dir, "pages")))
    return made.withColumn("block", F.decode("block", "UTF-8"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "emptied", "text")


SQL_OP4 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
t AS (
  SELECT doc_id, l, lines[l + 1] AS line, list_distinct(list_filter(string_split_regex(lower(lines[l + 1]), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS l FROM d)
), c AS (
  SELECT w, min(doc_id * 1000000 + l) AS p FROM (SELECT doc_id, l, list_sort(w) AS w FROM t WHERE len(w) > 0) GROUP BY w
), f AS (SELECT s, count(*) AS n FROM (SELECT unnest(w) AS s FROM c) GROUP BY s),
o AS (SELECT p, list(s ORDER BY f.n, s) AS w FROM (SELECT p, unnest(w) AS s FROM c) JOIN f USING (s) GROUP BY p),
x AS (SELECT p, w, unnest(w[1:len(w) - CAST(ceil(len(w) * 80 / 100.0) AS BIGINT) + 1]) AS s FROM o),
q AS (SELECT DISTINCT a.p AS a, b.p AS b FROM x a JOIN x b ON a.s = b.s AND b.p < a.p AND 100 * least(len(a.w), len(b.w)) >= 80 * greatest(len(a.w), len(b.w))),
r AS (
  SELECT DISTINCT a FROM (SELECT a, u.w AS u, v.w AS v, len(list_intersect(u.w, v.w)) AS i FROM q JOIN o u ON u.p = a JOIN o v ON v.p = b)
  WHERE 100 * i >= 80 * (len(u) + len(v) - i)
), k AS (SELECT p FROM c WHERE p NOT IN (SELECT a FROM r)),
g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (len(w) > 0 AND p IS NULL) AS n_removed, count(*) FILTER (len(w) > 0 AND p IS NOT NULL) AS n_left,
         string_agg(line, chr(10) ORDER BY l) FILTER (len(w) = 0 OR p IS NOT NULL) AS left_text
  FROM t LEFT JOIN k ON p = doc_id * 1000000 + l GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_removed > 0 AND n_left = 0, FALSE) AS emptied,
       CASE WHEN d.text IS NOT NULL THEN coalesce(left_text, '') END AS text
FROM d LEFT JOIN g USING (doc_id)
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read(spark, sf_dir, "documents"))


SQL_OP6 = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex({SQL_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM t
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL_OP8 = rf"""
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex({SQL_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex({SQL_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i+least(len(w), 13)-1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)
), k AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM t, k WHERE len(w) >= k)
), h AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, s)),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
m AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM t LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: the words of boilerplate, and a digest of the text without it."""
    return quality(read(spark, sf_dir, "documents")).withColumn("left_sha256", F.sha2("text", 256)).drop("text")


SQL_OP2 = rf"""
WITH t AS (
  SELECT doc_id, coalesce('h' || source, '') AS host, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)
), r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c >= 2) GROUP BY doc_id),
x AS (
  SELECT doc_id, host, trim(regexp_replace({SQL_LOWER.format("l")}, '[\x20\x09-\x0D]+', ' ', 'g')) AS l
  FROM (SELECT doc_id, host, unnest(l) AS l FROM t)
), o AS (
  SELECT host, l FROM x GROUP BY host, l HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), b AS (SELECT doc_id, sum(len(string_split(l, ' '))) AS n FROM x JOIN o USING (host, l) GROUP BY doc_id),
c AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(b.n, 0)::BIGINT AS n_boilerplate_words
  FROM t LEFT JOIN r USING (doc_id) LEFT JOIN b USING (doc_id)
), y AS (
  SELECT doc_id, host, i, line, trim(regexp_replace({SQL_LOWER.format("line")}, '[\x20\x09-\x0D]+', ' ', 'g')) AS l
  FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM t)
), z AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (o.l IS NULL), '') AS left_text FROM y LEFT JOIN o ON o.host = y.host AND o.l = y.l AND y.l <> '' GROUP BY doc_id
), d AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT d.*, NOT base_failed AND n_words - n_boilerplate_words >= {MIN_WORDS} AND 100 * (n_words - n_boilerplate_words) >= {LEFT_PERCENT} * n_words AS kept,
       CASE WHEN text IS NOT NULL THEN sha256(coalesce(left_text, '')) END AS left_sha256
FROM d JOIN documents USING (doc_id) LEFT JOIN z USING (doc_id)
"""


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in two commits: half of them, dealt by a hash, and then all, of which half are in the ledger."""
    docs, folder = read(spark, sf_dir, "documents"), Scratch(spark, "secrets").path("ledger")
    commit(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), folder, first=True)
    return digest(commit(docs, folder))


def _sql_op9() -> str:
    one = r"""
  SELECT doc_id, {i} AS rule, '{kind}' AS kind, list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j-1], lambda x: length(x))), 0) AS a, m[j] AS s
  FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS j
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM t))
  """
    keep = r"CASE {} END"
    parts = " UNION ALL ".join(one.format(i=i, kind=r.kind, pattern=r.pattern.replace("'", "''")) for i, r in enumerate(RULES))
    whens = " ".join(f"WHEN rule = {i} THEN length(regexp_extract(s, '{r.pattern.replace(chr(39), chr(39) * 2)}', {r.group})) >= {r.least}" for i, r in enumerate(RULES))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT *, (a + length(s))::BIGINT AS b FROM ({parts}) WHERE {keep.format(whens)}),
x AS (
  SELECT doc_id, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access, count(*) FILTER (rule = 2) AS n_hex,
         sha256(coalesce(string_agg(kind || ':' || a::BIGINT || ':' || b, ',' ORDER BY a, rule) FILTER (rule < 3), '')) AS base_sha256,
         string_agg(kind || ':' || a::BIGINT || ':' || b, ',' ORDER BY a, rule) AS spans
  FROM f GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN x USING (doc_id)
"""


SQL_OP9 = _sql_op9()

#: The unsigned CRC-32 of a text in ASCII, by the reversed polynomial.
SQL_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)))"
)


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(read(spark, sf_dir, "documents")).drop("spans")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL_OP11 = rf"""
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), s AS (SELECT doc_id, w, ' ' || array_to_string(w, '  ') || ' ' AS s FROM t),
rules(rule, label, priority, keys, pattern) AS (VALUES {", ".join(f"({i}, {_quoted(r.label)}, {r.priority}, [{', '.join(map(_quoted, r.keys))}], {_quoted(r.spaced)})" for i, r in enumerate(license_rules()))}),
base(label, pattern) AS (VALUES {", ".join(f"({_quoted(label)}, {_quoted(' (' + p.replace(' ', '  ') + ') ')})" for p, label in BASE.items())}),
c AS (SELECT doc_id, rule, label, priority, s, pattern FROM s JOIN rules ON list_has_all(w, keys) WHERE regexp_matches(s, pattern)),
m AS (
  SELECT doc_id, rule, label, priority, string_split(trim(regexp_replace(s, pattern, ' ' || chr(1) || '\1' || chr(2) || ' ', 'g')), '  ') AS v FROM c
), x AS (
  SELECT doc_id, rule, label, priority, unnest(list_filter(range(len(v)), lambda i: starts_with(v[i + 1], chr(1)))) AS a, unnest(list_filter(range(1, len(v) + 1), lambda i: ends_with(v[i], chr(2)))) AS b FROM m
), k AS (
  SELECT x.*, EXISTS (SELECT 1 FROM x y WHERE y.doc_id = x.doc_id AND y.a <= x.a AND y.b >= x.b AND y.priority >= x.priority
    AND (y.a < x.a OR y.b > x.b OR y.priority > x.priority OR y.rule < x.rule)) AS within FROM x
), l AS (
  SELECT doc_id, label, CASE priority {" ".join(f"WHEN {i} THEN {v}::DOUBLE" for i, v in enumerate(WEIGHTS, 1))} END AS score FROM k WHERE NOT within
), b AS (
  SELECT doc_id, label, unnest(list_filter(range(len(v)), lambda i: starts_with(v[i + 1], chr(1)))) AS a
  FROM (SELECT doc_id, label, string_split(trim(regexp_replace(s, pattern, ' ' || chr(1) || '\1' || chr(2) || ' ', 'g')), '  ') AS v FROM s, base WHERE regexp_matches(s, pattern))
), bs AS (SELECT doc_id, count(*) AS n_base, min(a) AS first_word, max(a) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
ls AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM l UNION SELECT doc_id, label FROM b) GROUP BY doc_id),
sc AS (SELECT doc_id, max(score) AS score FROM l GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM s LEFT JOIN bs USING (doc_id) LEFT JOIN ls USING (doc_id) LEFT JOIN sc USING (doc_id)
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(read(spark, sf_dir, "documents"))


SQL_OP12 = rf"""
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, coalesce({SQL_CRC.format("doc_id::VARCHAR")}, 1) AS h FROM documents
), g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS bent, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS k FROM t),
p AS (SELECT doc_id, n, w, a, bent, 1 + (n - a) // (3 + k) AS p FROM g),
d AS (SELECT doc_id, n, CASE WHEN bent THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM p),
x AS (SELECT doc_id, i, array_to_string(w[i+1:i+3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(n - 2)) AS i FROM d WHERE n > 5)),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM x JOIN x y ON x.doc_id = y.doc_id AND x.s = y.s AND y.i > x.i),
b AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
r AS (SELECT doc_id, q, min(i) AS a, count(*) + 2 + q AS n FROM b GROUP BY doc_id, q, island),
u AS (SELECT doc_id, a, n, min(q) AS q FROM r WHERE n >= 2 * q GROUP BY doc_id, a, n HAVING n >= greatest(6, 4 * min(q))),
best AS (SELECT doc_id, a AS start, n AS length, q AS period FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n::DOUBLE / q DESC, a, q) AS i FROM u) WHERE i = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(a || ',' || n || ',' || q || chr(10), '' ORDER BY a, q) AS s FROM u GROUP BY doc_id),
gone AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(a + q, a + n)) AS i FROM u) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(s, '')) AS runs_sha256,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN gone USING (doc_id)
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"))


def _sql_leaf(n_chars: str) -> str:
    own = [n_chars if f == "n_chars" else f for f in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in own) + ")"


SQL_OP13 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf, {_sql_leaf("(n_chars::HUGEINT + 1)")} AS more, coalesce({SQL_CRC.format("doc_id::VARCHAR")} % 7 = 0, FALSE) AS bent FROM documents
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d
), lower_tree AS (
  SELECT tree, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM o
  UNION ALL
  SELECT tree, any_value(level) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM lower_tree WHERE n > 1 GROUP BY tree, i // 2
), roots AS (SELECT tree, h AS subroot FROM lower_tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS level, tree AS i, subroot AS h, count(*) OVER () AS n FROM roots
  UNION ALL
  SELECT any_value(level) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM upper_tree WHERE n > 1 GROUP BY i // 2
), root AS (SELECT h AS root FROM upper_tree WHERE n = 1),
steps AS (
  SELECT o.tree, o.i, a.level AS step, CASE WHEN b.i < a.i THEN 'l' WHEN b.i > a.i THEN 'r' ELSE '-' END || coalesce(b.h, '') AS s
  FROM o JOIN lower_tree a ON a.tree = o.tree AND a.n > 1 AND a.i = o.i >> a.level LEFT JOIN lower_tree b ON b.tree = a.tree AND b.level = a.level AND b.i = xor(a.i, 1)
  UNION ALL
  SELECT o.tree, o.i, 100 + a.level, CASE WHEN b.i < a.i THEN 'l' WHEN b.i > a.i THEN 'r' ELSE '-' END || coalesce(b.h, '')
  FROM o JOIN upper_tree a ON a.n > 1 AND a.i = o.tree >> a.level LEFT JOIN upper_tree b ON b.level = a.level AND b.i = xor(a.i, 1)
), p AS (SELECT tree, i, list(s ORDER BY step) AS s FROM steps GROUP BY tree, i),
f AS (
  SELECT doc_id, lang, leaf, subroot, root, sha256(array_to_string(list_transform(coalesce(s, []), lambda x: x[2:]), '')) AS proof_sha256,
         list_reduce(list_prepend(CASE WHEN bent THEN more ELSE leaf END, coalesce(s, [])), lambda h, x: CASE x[1] WHEN 'l' THEN sha256(x[2:] || h) WHEN 'r' THEN sha256(h || x[2:]) ELSE sha256(h) END) AS folded_root
  FROM o JOIN roots USING (tree) LEFT JOIN p USING (tree, i), root
)
SELECT *, folded_root = root AS verified FROM f
"""


#: Name, query, SQL or None.
ALL = [
    ("op1_packing", op1_packing, None),
    ("op2_quality_rules", op2_quality_rules, SQL_OP2),
    ("op3_warc_derivatives", op3_warc_derivatives, None),
    ("op4_line_dedup", op4_line_dedup, SQL_OP4),
    ("op5_toxicity", op5_toxicity, None),
    ("op6_ngram_jaccard_join", op6_ngram_jaccard_join, SQL_OP6),
    ("op7_url_filters", op7_url_filters, None),
    ("op8_benchmark_decontamination", op8_benchmark_decontamination, SQL_OP8),
    ("op9_secret_scans", op9_secret_scans, SQL_OP9),
    ("op10_token_id_files", op10_token_id_files, None),
    ("op11_license_scans", op11_license_scans, SQL_OP11),
    ("op12_periodic_runs", op12_periodic_runs, SQL_OP12),
    ("op13_merkle_manifest", op13_merkle_manifest, SQL_OP13),
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, query, _ in ALL}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in ALL if sql}
