"""More queries over the driver's tables: lists of urls, page heads, exports, entities and jobs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..operators import exports as X
from ..operators import relational as R
from ..sources.tables import table
from .queries import _KEY, _PAIRS, NOW, SQL, _strip, _values, query


def _quoted(x: str) -> str:
    return x.replace("'", "''")


# Urls

#: Separators of pasted lists.
_SEPARATORS = ["\n", "%0A", "", "%20 ", "'\t<"]
_GLUE = "CASE page_id % 5 " + " ".join(f"WHEN {i} THEN '{_quoted(x)}'" for i, x in enumerate(_SEPARATORS)) + " END"
_LIST_KEY = _KEY.replace("SELECT page_id, u,", "SELECT page_id, i, u,").replace("{0}", "(SELECT * FROM x WHERE u LIKE 'http://%' OR u LIKE 'https://%')")


@query(rf"""WITH r AS (SELECT page_id // 20 AS list, string_agg(url || {_GLUE}, '' ORDER BY page_id) AS raw FROM pages GROUP BY ALL),
t AS (SELECT list, string_split_regex(regexp_replace(regexp_replace(regexp_replace(raw, '%0[aAdD]', chr(10), 'g'), '%(?:20|09)', ' ', 'g'), '(https?://)', ' \1', 'g'), '{T.SPACE}+') AS w FROM r),
x AS (SELECT list AS page_id, i, regexp_replace(w[i], '{_quoted(C.LIST_MARKS)}', '', 'g') AS u FROM (SELECT list, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
k AS ({_LIST_KEY}),
f AS (SELECT page_id, i, u, row_number() OVER (PARTITION BY page_id, url_key ORDER BY i) AS n FROM k)
SELECT page_id AS list, count(*) AS n, string_agg(u, ' ' ORDER BY i) AS urls FROM f WHERE n = 1 GROUP BY page_id""")
def url_list_parse(spark, d):
    glue = F.element_at(F.array(*map(F.lit, _SEPARATORS)), (F.col("page_id") % 5 + 1).cast("int"))
    pasted = F.struct("page_id", F.concat("url", glue).alias("x"))
    lists = table(spark, d, "pages").groupBy(F.floor(F.col("page_id") / 20).alias("list")).agg(F.sort_array(F.collect_list(pasted)).alias("p"))
    found = U.listed(F.array_join(F.transform("p", lambda x: x["x"]), ""))
    return lists.select("list", found.alias("u")).select("list", F.size("u").cast("bigint").alias("n"), F.array_join("u", " ").alias("urls"))


# Pages

_BODY = "An article's body of some length. " * 8
#: Pages whose heads and structured data are known.
_PAGES = [
    f'<meta property="og:description" content=" A &amp; B "><script type="application/ld+json">{{"@type": "News", "articleBody": "{_BODY}"}}</script>',
    f'<meta content="Plain" name="description"><script type="application/ld+json">[{{"a": 1}}, {{"articleBody": "{_BODY}x"}}]</script>',
    f'<script type="application/ld+json">{{"@graph": [{{"articleBody": "short"}}, {{"articleBody": "{_BODY}y"}}]}}</script>',
    f'<script type="application/ld+json">not json</script><script id="2" type="application/ld+json"> {{"articleBody": "{_BODY}z"}} </script>',
    '<meta name="description" content="">',
    None,
]
_SQL_PAGES = f"(SELECT page_id, html FROM pages UNION ALL SELECT * FROM {_values([(-1 - i, h) for i, h in enumerate(_PAGES)], 'page_id, html')})"


def _pages(spark, d) -> DataFrame:
    more = spark.createDataFrame([(-1 - i, h) for i, h in enumerate(_PAGES)], "page_id bigint, html string")
    return table(spark, d, "pages").select("page_id", "html").union(more)


def _sql_meta(attribute: str, name: str) -> str:
    named, content = f"{attribute}=[\"'']{name}[\"'']", "content=[\"'']([^\"'']*)[\"'']"
    ahead = f"regexp_extract(html, '(?is)<meta[^>]*{named}[^>]*{content}', 1)"
    out = f"coalesce(CASE WHEN {ahead} <> '' THEN {ahead} ELSE regexp_extract(html, '(?is)<meta[^>]*{content}[^>]*{named}', 1) END, '')"
    for a, b in H.NAMED.items():
        out = f"replace({out}, '{a}', '{_quoted(b)}')"
    return _strip(out)


_TEXT = _strip("regexp_replace(coalesce(html, ''), '(?s)<script.*?</script>|<[^>]*>', '', 'g')")


@query(f"""WITH m AS (SELECT page_id, {_sql_meta("property", "og:description")} AS og, {_sql_meta("name", "description")} AS plain, {_TEXT} AS t FROM {_SQL_PAGES}),
x AS (SELECT page_id, t, CASE WHEN og <> '' THEN og ELSE plain END AS description FROM m)
SELECT page_id, description, md5(CASE WHEN length(t) < {C.LEAST_TEXT} AND description <> '' AND NOT contains(t, description) THEN description || chr(10) || chr(10) || t ELSE t END) AS text_md5 FROM x""")
def page_description(spark, d):
    h = F.coalesce("html", F.lit(""))
    text = T.strip(F.regexp_replace(h, "(?s)<script.*?</script>|<[^>]*>", ""))
    return _pages(spark, d).select("page_id", H.description(h).alias("description"), F.md5(H.with_description(text, h)).alias("text_md5"))


@query(f"""WITH s AS (SELECT page_id, j, {_strip("r[j]")} AS raw FROM (SELECT page_id, r, unnest(range(1, len(r) + 1)) AS j FROM (SELECT page_id, regexp_extract_all(html, '{H.SCRIPT}', 1) AS r FROM {_SQL_PAGES}))),
i AS (SELECT page_id, j, CASE WHEN json_type(raw) = 'ARRAY' THEN CAST(raw::JSON AS JSON[]) ELSE [raw::JSON] END AS own FROM s WHERE json_valid(raw)),
g AS (SELECT page_id, j, coalesce(CAST(list_filter(list_transform(own, lambda x: x->'$."@graph"'), lambda x: x IS NOT NULL)[1] AS JSON[]), own) AS own FROM i),
b AS (SELECT page_id, j, k, own[k]->>'$.articleBody' AS body FROM (SELECT page_id, j, own, unnest(range(1, len(own) + 1)) AS k FROM g)),
f AS (SELECT page_id, arg_min(body, j * 1000000 + k) AS body FROM b WHERE length(body) >= {C.LEAST_BODY} GROUP BY page_id)
SELECT p.page_id, coalesce(array_to_string(list_filter(list_transform(string_split_regex(body, '{T.LINE_END}'), lambda x: {_strip("x")}), lambda x: length(x) >= 4), chr(10) || chr(10)), '') AS body
FROM {_SQL_PAGES} p LEFT JOIN f USING (page_id)""")
def page_jsonld(spark, d):
    return _pages(spark, d).select("page_id", H.article_body(F.col("html")).alias("body"))


@query(f"""SELECT page_id, left(url, {C.URL_CAP}) AS url, left(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), {C.TITLE_CAP}) AS title, md5(left(html, {C.TEXT_CAP})) AS text_md5,
length(html) > {C.TEXT_CAP} AS cut, sum((length(html) > {C.TEXT_CAP})::INT) OVER ()::BIGINT AS n_cut FROM pages""")
def content_normalised(spark, d):
    h = F.col("html")
    p = table(spark, d, "pages").select(
        "page_id",
        F.left("url", F.lit(C.URL_CAP)).alias("url"),
        F.left(F.regexp_extract(h, "(?is)<title[^>]*>(.*?)</title>", 1), F.lit(C.TITLE_CAP)).alias("title"),
        F.md5(F.left(h, F.lit(C.TEXT_CAP))).alias("text_md5"),
        (F.length(h) > C.TEXT_CAP).alias("cut"),
    )
    return p.crossJoin(F.broadcast(p.agg(F.count_if("cut").alias("n_cut"))))


# Exports


@query("""WITH d AS (SELECT source AS dataset, doc_id, n_chars, coalesce(text, '') AS text, n_chars >= 500 AND text <> '' AS ok FROM documents),
h AS (SELECT dataset, 0 AS part, -1::BIGINT AS doc_id, '# ' || dataset || chr(10) || chr(10) || '> 共 ' || count(*) || ' 個網址，成功 ' || count(*) FILTER (ok) || ' 篇' AS block FROM d GROUP BY dataset)
SELECT dataset, part, doc_id, md5(block) AS block_md5 FROM (SELECT * FROM h UNION ALL
SELECT dataset, 1, doc_id, '## (無標題)' || chr(10) || chr(10) || '- 網址：' || doc_id || chr(10) || '- 字數：' || n_chars || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' FROM d WHERE ok UNION ALL
SELECT dataset, 2, doc_id, '- [failed] ' || doc_id || ' — short' FROM d WHERE NOT ok)""")
def dataset_markdown(spark, d):
    """A dataset's export as blocks in order of part and document: its head, its texts, and what failed."""
    items = table(spark, d, "documents").select(F.col("source").alias("dataset"), "doc_id", "n_chars", F.coalesce("text", F.lit("")).alias("text"))
    items = items.withColumn("ok", (F.col("n_chars") >= 500) & (F.col("text") != ""))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    head = items.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if("ok").alias("m"))
    head = head.select("dataset", F.lit(0).alias("part"), F.lit(-1).cast("bigint").alias("doc_id"), say("# ", F.col("dataset"), "\n\n> 共 ", F.col("n"), " 個網址，成功 ", F.col("m"), " 篇").alias("block"))
    whole = say("## (無標題)\n\n- 網址：", F.col("doc_id"), "\n- 字數：", F.col("n_chars"), "\n\n", F.col("text"), "\n\n---")
    failed = say("- [failed] ", F.col("doc_id"), " — short")
    rows = items.select("dataset", F.when(F.col("ok"), 1).otherwise(2).alias("part"), "doc_id", F.when(F.col("ok"), whole).otherwise(failed).alias("block"))
    return head.union(rows).select("dataset", "part", "doc_id", F.md5("block").alias("block_md5"))


def _sql_cell(x: str) -> str:
    safe = rf"CASE WHEN regexp_matches({x}, '^[=+\-@\t\r]') THEN '''' || {x} ELSE coalesce({x}, '') END"
    return rf"""CASE WHEN regexp_matches({safe}, '[,"\n\r]') THEN '"' || replace({safe}, '"', '""') || '"' ELSE {safe} END"""


@query(f"SELECT conv_id, turn, md5(conv_id || ',' || turn || ',' || {_sql_cell('role')} || ',' || {_sql_cell('text')}) AS line_md5 FROM conversations")
def csv_lines(spark, d):
    """Lines of a CSV export, quoted where needed, with no cell that a spreadsheet takes for a formula."""

    def cell(x: Column) -> Column:
        safe = T.csv_safe(x)
        return F.when(safe.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)

    line = F.concat_ws(",", F.col("conv_id").cast("string"), F.col("turn").cast("string"), cell(F.col("role")), cell(F.col("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(line).alias("line_md5"))


@query(r"""SELECT doc_id, regexp_replace(left(name, 80), '[^\w\-. ]', '_', 'g') AS file, replace(replace(left(name, 200), '/', '_'), '.', '_') AS id,
least(16384, greatest(2048, 2 * length(text) + 1024))::BIGINT AS budget, format('{:,}', length(text)) AS chars
FROM (SELECT doc_id, text, lang || '/' || source || '.' || doc_id || '?' AS name FROM documents WHERE text IS NOT NULL)""")
def names_and_budgets(spark, d):
    n = F.length("text")
    docs = table(spark, d, "documents").where("text is not null")
    docs = docs.withColumn("name", F.concat("lang", F.lit("/"), "source", F.lit("."), F.col("doc_id").cast("string"), F.lit("?")))
    return docs.select(
        "doc_id",
        F.regexp_replace(F.left("name", F.lit(80)), r"[^\w\-. ]", "_").alias("file"),
        F.translate(F.left("name", F.lit(200)), "/.", "__").alias("id"),
        F.least(F.lit(16384), F.greatest(F.lit(2048), 2 * n + 1024)).cast("bigint").alias("budget"),
        F.format_number(n, 0).alias("chars"),
    )


# Entities and jobs


@query(f"""WITH e AS (SELECT 'part ' || (l_partkey % 997) AS name, l_returnflag AS kind, CAST(l_discount AS DECIMAL(18, 2)) AS s, CAST(l_quantity AS BIGINT) AS m, l_orderkey * 100 + l_linenumber AS place FROM lineitem)
SELECT name, arg_max(kind, place) AS kind, sum(s)::DOUBLE AS salience, sum(m)::BIGINT AS mentions FROM e GROUP BY name HAVING sum(s) >= {C.LEAST_SALIENCE} ORDER BY sum(s) DESC, name LIMIT {C.TOP_ENTITIES}""")
def entity_rollup(spark, d):
    name = F.concat(F.lit("part "), (F.col("l_partkey") % 997).cast("string"))
    at = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at")
    e = table(spark, d, "lineitem").select(name.alias("name"), F.col("l_returnflag").alias("kind"), F.col("l_discount").cast("decimal(18,2)").alias("s"), F.col("l_quantity").cast("bigint").alias("m"), at)
    e = e.groupBy("name").agg(F.max_by("kind", "at").alias("kind"), F.sum("s").cast("double").alias("salience"), F.sum("m").alias("mentions"))
    return e.where(F.col("salience") >= C.LEAST_SALIENCE).orderBy(F.desc("salience"), "name").limit(C.TOP_ENTITIES)


def _sql_line(*cells: str) -> str:
    return " || ',' || ".join(_sql_cell(f"({c})::VARCHAR") for c in cells) + " || chr(13) || chr(10)"


def _sql_shown(x: str) -> str:
    return rf"regexp_replace(CAST({x} AS DECIMAL(20, 4))::VARCHAR, '(\.\d+?)0+$', '\1')"


_HEADS = {k: ",".join(v) for k, v in C.EXPORT_HEADS.items()}
_END = "chr(13) || chr(10)"


@query(f"""WITH words AS (SELECT *, row_number() OVER (ORDER BY weight DESC, term) AS rank FROM ({SQL["tfidf_top_keywords"]})),
sets AS (SELECT * FROM (WITH {_PAIRS} SELECT 0 AS part, row_number() OVER (ORDER BY n DESC, first, a, b) AS rank, a || ' + ' || b AS x, n, round(n / total, {C.SHARE_PLACES}) AS support FROM q) WHERE rank <= {C.ASSOC_SETS}),
rules AS (SELECT *, row_number() OVER () AS rank FROM ({SQL["association_rules"]})),
pairs AS (
  SELECT part, rank, {_sql_line("'itemset'", "x", "''", _sql_shown("support"), "''", "''", "n")} AS line FROM sets
  UNION ALL SELECT 1, rank, {_sql_line("'rule'", '"if"', '"then"', _sql_shown("support"), _sql_shown("confidence"), _sql_shown("lift"), '"count"')} FROM rules
), ents AS (SELECT *, row_number() OVER (ORDER BY salience DESC, name) AS rank FROM ({SQL["entity_rollup"]}))
SELECT 'tfidf' AS name, '{_HEADS["tfidf"]}' || {_END} || coalesce(string_agg({_sql_line("rank", "term", _sql_shown("weight"))}, '' ORDER BY rank), '') AS csv FROM words
UNION ALL SELECT 'association', '{_HEADS["association"]}' || {_END} || coalesce(string_agg(line, '' ORDER BY part, rank), '') FROM pairs
UNION ALL SELECT 'entities', '{_HEADS["sentiment"]}' || {_END} || 'enabled,True' || {_END} || 'n_docs,' || (SELECT count(*) FROM documents) || {_END} || 'avg_sentiment,' || {_END} || chr(10) || '{_HEADS["entities"]}' || {_END}
  || coalesce(string_agg({_sql_line("name", "kind", _sql_shown("salience"), "mentions")}, '' ORDER BY rank), '') FROM ents""")
def numeric_exports(spark, d):
    docs = table(spark, d, "documents")
    return X.numeric_exports(docs, entity_rollup(spark, d), docs.count())


@query(f"SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O' AND o_orderdate < TIMESTAMP '{NOW}' - INTERVAL {C.KEEP_DAYS} DAY ORDER BY o_orderdate, o_orderkey LIMIT {C.SWEEP}")
def retention_sweep(spark, d):
    old = F.col("o_orderdate") < F.expr(f"timestamp_ntz'{NOW}' - interval {C.KEEP_DAYS} day")
    return table(spark, d, "orders").where((F.col("o_orderstatus") != "O") & old).orderBy("o_orderdate", "o_orderkey").limit(C.SWEEP).select("o_orderkey", "o_orderstatus")


@query(f"""WITH j AS (SELECT user_id, max(ts) AS seen, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id)
SELECT c_custkey, CASE WHEN last IS NULL THEN 'none' WHEN last = 'error' THEN 'failed' WHEN last IN ('signup', 'purchase') THEN 'completed'
WHEN seen IS NULL OR seen < TIMESTAMP '{NOW}' - INTERVAL {C.SILENT_MINUTES} MINUTE THEN 'failed' ELSE 'running' END AS state
FROM customer LEFT JOIN j ON user_id = c_custkey""")
def job_self_heal(spark, d):
    jobs = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("seen"), F.max_by("event_type", "event_id").alias("last"))
    silent = F.col("seen").isNull() | (F.col("seen") < F.expr(f"timestamp_ntz'{NOW}' - interval {C.SILENT_MINUTES} minute"))
    state = F.when(F.col("last").isNull(), "none").when(F.col("last") == "error", "failed").when(F.col("last").isin("signup", "purchase"), "completed").when(silent, "failed").otherwise("running")
    return table(spark, d, "customer").join(jobs, F.col("user_id") == F.col("c_custkey"), "left").select("c_custkey", state.alias("state"))


@query("""WITH i AS (SELECT l_orderkey AS job, (l_linenumber - 1) // 3 AS chunk, l_returnflag AS s FROM lineitem),
c AS (SELECT job, chunk, count(*) FILTER (s = 'N') AS s, count(*) FILTER (s = 'A') AS k, count(*) FILTER (s = 'R') AS f FROM i GROUP BY job, chunk),
j AS (SELECT job, sum(s)::BIGINT AS succeeded, sum(k)::BIGINT AS skipped, sum(f)::BIGINT AS failed, count(*) AS done, max(chunk) + 1 AS chunks FROM c GROUP BY job)
SELECT job, succeeded, skipped, failed, CASE WHEN done >= chunks THEN 100 ELSE least(99, floor(100.0 * done / chunks)) END::BIGINT AS progress, CASE WHEN done >= chunks THEN 'completed' ELSE 'running' END AS status FROM j""")
def chunk_completion(spark, d):
    """Chunks that have reported, once each, and what they add up to."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.floor((F.col("l_linenumber") - 1) / 3).alias("chunk"), F.col("l_returnflag").alias("s"))
    c = items.groupBy("job", "chunk").agg(*[F.count_if(F.col("s") == flag).alias(name) for flag, name in (("N", "succeeded"), ("A", "skipped"), ("R", "failed"))])
    j = c.groupBy("job").agg(*[F.sum(x).alias(x) for x in ("succeeded", "skipped", "failed")], F.count("*").alias("done"), (F.max("chunk") + 1).alias("chunks"))
    over = F.col("done") >= F.col("chunks")
    progress = F.when(over, 100).otherwise(F.least(F.lit(99), F.floor(100 * F.col("done") / F.col("chunks"))))
    return j.select("job", "succeeded", "skipped", "failed", progress.cast("bigint").alias("progress"), F.when(over, "completed").otherwise("running").alias("status"))


@query("""WITH e AS (SELECT event_id, user_id, event_type = 'error' AS bad, value FROM events),
w AS (SELECT *, coalesce(sum(value::DECIMAL(18, 2)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS took,
  bad AND coalesce(lag(bad) OVER o, FALSE) AND coalesce(lag(bad, 2) OVER o, FALSE) AS hung FROM e WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, coalesce(bool_or(hung) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) = FALSE AND took <= 500 AS attempted FROM w""")
def crawl_attempts(spark, d):
    e = table(spark, d, "events")
    return R.attempts(e, "user_id", ["event_id"], F.col("event_type") == "error", F.col("value").cast("decimal(18,2)"), limit=500).select("event_id", "attempted")


@query("""WITH old AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS seq FROM documents SEMI JOIN labels USING (doc_id)),
new AS (SELECT doc_id, (SELECT coalesce(max(seq) + 1, 0) FROM old) + row_number() OVER (ORDER BY doc_id) - 1 AS seq FROM documents ANTI JOIN labels USING (doc_id))
SELECT doc_id, seq, lpad(seq::VARCHAR, 12, '0') AS key, seq // 400 AS batch FROM (FROM old UNION ALL FROM new)""")
def items_append_numbered(spark, d):
    """Labelled documents are there first; the others are appended behind them. With zero-padded keys, and the batch each is written in."""
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    old = R.numbered(docs.join(labels, "doc_id", "left_semi"), "doc_id")
    out = R.append_numbered(old, docs.join(labels, "doc_id", "left_anti"), "doc_id")
    return out.select("doc_id", "seq", F.lpad(F.col("seq").cast("string"), 12, "0").alias("key"), F.floor(F.col("seq") / 400).alias("batch"))


@query("""SELECT event_type, count(*) AS calls, sum((props->>'k')::BIGINT)::BIGINT AS tokens, arg_max(user_id, (ts, event_id)) AS last_user,
strftime(max(ts) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS last_seen FROM events GROUP BY event_type""")
def usage_last_provider(spark, d):
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    last = F.date_format((F.max("ts") + F.expr("interval 8 hours")).cast("timestamp"), "yyyy-MM-dd HH:mm")
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(k).alias("tokens"), F.max_by("user_id", "at").alias("last_user"), last.alias("last_seen"))


@query("""SELECT l_orderkey, string_agg(l_returnflag || '=' || n, ',' ORDER BY i, l_returnflag) AS first_seen FROM
(SELECT l_orderkey, l_returnflag, count(*) AS n, min(l_linenumber) AS i FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""")
def counts_in_first_seen_order(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("i"))
    said = F.transform(F.sort_array(F.collect_list(F.struct("i", "l_returnflag", "n"))), lambda x: F.concat_ws("=", x["l_returnflag"], x["n"].cast("string")))
    return c.groupBy("l_orderkey").agg(F.array_join(said, ",").alias("first_seen"))


# Images and scores

#: Candidates of a set of sources that is written from a page's url: what stands behind it, and its descriptor.
_SOURCES = [("/a,b;0,0.jpg", "{0}w"), ("/c.jpg", ""), ("/d.jpg,x", "{1}.5w"), ("/e.jpg", "{2}x")]
_SIZES = ["(page_id * 7 % 5) * 100", "page_id % 400", "page_id % 3"]
_SET = " || ', ' || ".join("url || '" + tail + "'" + (f" || ' ' || ({_SIZES[int(size[1])]}) || '{size[3:]}'" if size else "") for tail, size in _SOURCES)
_SCORES = ["0.0" if not size else f"(({_SIZES[int(size[1])]}) || '{size[3:-1]}')::DOUBLE" for _, size in _SOURCES]


@query(f"""WITH c AS (SELECT page_id, unnest([{", ".join(f"{{'s': {score}, 'i': {i}, 'u': url || '{tail}'}}" for i, ((tail, _), score) in enumerate(zip(_SOURCES, _SCORES)))}]) AS c FROM pages WHERE url <> ''),
b AS (SELECT page_id, max_by(c.u, (c.s, c.i)) AS best FROM c GROUP BY page_id)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN best WHEN page_id % 3 = 1 THEN url || '?late' ELSE url END AS image FROM pages JOIN b USING (page_id)""")
def image_best_source(spark, d):
    """Two pages in three have no set of sources: one has its image in an attribute of late loading, the other in itself or where it stands."""
    p = table(spark, d, "pages").where("url <> ''").withColumn("set", F.expr(_SET))
    kind = F.col("page_id") % 3
    lazy = [F.when(kind == 1, F.concat(F.lit(" "), "url", F.lit("?late "))) if a == C.LAZY_ATTRIBUTES[1] else F.when(kind == 2, "data:image/gif;base64,R0") if a == C.LAZY_ATTRIBUTES[0] else F.lit("") for a in C.LAZY_ATTRIBUTES]
    return p.select("page_id", H.best_image(F.when(kind == 0, F.col("set")), F.array().cast("array<string>"), lazy, F.col("url")).alias("image"))


@query(f"""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('images:' || doc_id), doc_id) AS i FROM documents) WHERE i <= {C.SAMPLE_SIZE}""")
def keyed_sample(spark, d):
    return R.sampled(table(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id", C.SAMPLE_SIZE, "images")


@query(f"""WITH s AS (SELECT source, doc_id, length(text) * 0.2::DOUBLE AS score, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS i FROM documents WHERE text IS NOT NULL),
b AS (SELECT source, max(doc_id) FILTER (i = 1) AS doc_id, max(score) FILTER (i = 1) AS best, max(score) FILTER (i = 2) AS second FROM s WHERE i <= 2 GROUP BY source)
SELECT source, b.doc_id, round(0.4 * CASE WHEN best > 0 THEN least(1.0, greatest(best - coalesce(second, 0), 0) / best * 2) ELSE 0 END
+ 0.3 * CASE WHEN best >= {C.SURE_SCORE} THEN 1.0 WHEN best >= {C.LIKELY_SCORE} THEN 0.7 + (best - {C.LIKELY_SCORE}) / {C.SURE_SCORE - C.LIKELY_SCORE} * 0.3 ELSE best / {C.LIKELY_SCORE} * 0.7 END
+ 0.3 * least(1.0, 0.5 + CASE WHEN lang = 'en' THEN 0.2 ELSE 0 END + CASE WHEN b.doc_id % 2 = 0 THEN 0.15 ELSE 0 END + CASE WHEN len(string_split(text, chr(10))) >= 5 THEN 0.15 ELSE 0 END), 6) AS confidence
FROM b JOIN documents USING (doc_id, source)""")
def margin_confidence(spark, d):
    """The longest text of each source against the next; the language stands for a heading, and even numbers for a date."""
    docs = table(spark, d, "documents")
    b = R.best_two(docs.withColumn("score", F.length("text") * F.lit(0.2)), ["source"], "score", "doc_id").join(docs, ["source", "doc_id"])
    sure = H.confidence(F.col("best"), F.col("second"), F.col("lang") == "en", F.col("doc_id") % 2 == 0, F.size(F.split("text", "\n")))
    return b.select("source", "doc_id", F.round(sure, 6).alias("confidence"))
