"""Queries over the driver's tables, each with its equivalent DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchwork.functions import clean as cleaning
from parchwork.functions import decode as decoding
from parchwork.functions import formats, paths
from parchwork.functions.words import sort_base, words
from parchwork.operators import logs, reports
from parchwork.operators import vocabulary as vocab
from parchwork.plans import flows, shared_folder
from parchwork.sources import sinks
from parchwork.streaming import vocabulary as streaming

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    """Registers a query, with SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose texts are worked on."""
    return flows.spread(_table(spark, sf_dir, name).select(*columns))


# --- SQL for the steps that many queries share ---

_LETTERS = r"[\p{L}\p{Mn}\x{2600}-\x{10FFFF}]+"


def _sql_words(text: str) -> str:
    return rf"list_distinct(list_transform(regexp_extract_all(translate({text}, 'ªº', '  '), '{_LETTERS}'), lambda x: lower(x)))"


_SQL_BASE = "replace(replace(replace(replace(strip_accents(word), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o')"


def _sql_clean(html: str) -> str:
    """Sound for the driver's pages, whose attributes hold no angle brackets and whose entities are these four."""
    names = "|".join(cleaning.BLOCKS)
    whole = "|".join(rf"<{n}\b[^>]*>.*?</{n}\s*>" for n in ("script", "style", "template", "noscript"))
    steps = [
        (r"(?s)<!--.*?-->", "chr(10)"), (rf"(?is)(?:{whole})", "chr(10)"), (r"(?is)<(?:script|style)\b[^>]*>.*\z", "chr(10)"),
        (rf"(?i)</?(?:{names})(?:[^a-zA-Z0-9>][^>]*)?>", "chr(10)"), (r"<[a-zA-Z/!?][^>]*>", "''"), (r"<[a-zA-Z/!?][^>]*\z", "chr(10)"),
    ]
    out = html
    for pattern, by in steps:
        out = f"regexp_replace({out}, '{pattern}', {by}, 'g')"
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    for pattern, by in ((r"[ \t\r\f\x0b\x{a0}]+", "' '"), (r"(?m)^\s+|[^\S\n]+$", "''"), (r"\n{3,}", "chr(10) || chr(10)"), (r"\A\s+|\s+\z", "''")):
        if pattern.startswith("(?m)"):
            out = f"array_to_string(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), chr(10))"
        else:
            out = f"regexp_replace({out}, '{pattern}', {by}, 'g')"
    return out


_PAGES_CLEAN = f"clean AS (SELECT page_id, {_sql_clean('html')} AS text FROM pages)"
_PAGE_WORDS = f"WITH {_PAGES_CLEAN}, w AS (SELECT DISTINCT page_id, unnest({_sql_words('text')}) AS word FROM clean)"
_DOC_WORDS = f"WITH w AS (SELECT DISTINCT doc_id, lang, unnest({_sql_words('text')}) AS word FROM documents)"
_POSITIONS = f"SELECT word, row_number() OVER (ORDER BY {_SQL_BASE}, word) AS pos FROM (SELECT DISTINCT word FROM w)"


def _stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.strip_table(_texts(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html")


# --- Cleaning and words ---


@_query(f"WITH {_PAGES_CLEAN} SELECT page_id, text, text = '' AS empty FROM clean")
def strip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stripped(spark, sf_dir).select("page_id", "text", "empty")


@_query(f"{_PAGE_WORDS} SELECT page_id, word FROM w")
def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.document_words(_stripped(spark, sf_dir), "page_id", "text")


@_query(f"{_DOC_WORDS} SELECT doc_id, word FROM w")
def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.document_words(_texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


@_query(f"SELECT DISTINCT conv_id, turn, unnest({_sql_words('text')}) AS word FROM conversations")
def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.explode(words(F.col("text"))).alias("word")).distinct()


@_query(f"SELECT item_id, unnest({_sql_words('text')}) AS word FROM benchmark")
def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.document_words(_table(spark, sf_dir, "benchmark"), "item_id", "text")


@_query(f"{_DOC_WORDS} SELECT doc_id, count(word) AS n_words FROM w GROUP BY doc_id")
def doc_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words")).where("n_words > 0")


@_query(f"{_PAGE_WORDS} {_POSITIONS}")
def vocabulary_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.with_positions(vocab.vocabulary(_stripped(spark, sf_dir), "text"))


@_query(f"{_DOC_WORDS} {_POSITIONS}")
def vocabulary_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.with_positions(vocab.vocabulary(_texts(spark, sf_dir, "documents", "text"), "text"))


@_query(f"{_DOC_WORDS} SELECT count(DISTINCT word) AS words FROM w")
def vocabulary_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.vocabulary_size(_texts(spark, sf_dir, "documents", "text"), "text")


@_query(f"{_DOC_WORDS} SELECT lang, count(DISTINCT word) AS words FROM w GROUP BY lang")
def vocabulary_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.vocabulary_size(_texts(spark, sf_dir, "documents", "lang", "text"), "text", ["lang"])


@_query(f"{_DOC_WORDS} SELECT DISTINCT word, {_SQL_BASE} AS base FROM w")
def sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.vocabulary(_texts(spark, sf_dir, "documents", "text"), "text").select("word", sort_base(F.col("word")).alias("base"))


@_query(
    f"""{_PAGE_WORDS}, p AS ({_POSITIONS}), n AS (SELECT max(pos) AS n FROM p)
    SELECT 'first' AS "end", pos AS place, word FROM p WHERE pos <= 6
    UNION ALL SELECT 'last', n - pos + 1, word FROM p, n WHERE pos > n - 4"""
)
def first_last_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.ends(shared_folder.stored(vocab.vocabulary(_stripped(spark, sf_dir), "text"), "vocabulary"), 6, 4)


@_query(
    f"""SELECT DISTINCT word FROM (SELECT unnest({_sql_words('text')}) AS word FROM documents UNION ALL
    SELECT unnest({_sql_words('text')}) FROM conversations UNION ALL SELECT unnest({_sql_words('text')}) FROM benchmark)"""
)
def vocabulary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [_texts(spark, sf_dir, t, "text") for t in ("documents", "conversations", "benchmark")]
    return vocab.vocabulary(texts[0].unionByName(texts[1]).unionByName(texts[2]), "text")


@_query(f"{_DOC_WORDS} SELECT DISTINCT word FROM w")
def vocabulary_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the documents, gathered by a stream over their files."""
    folder = shared_folder.fresh(spark, "stream")
    # As a pattern the table may be one file or a folder of files.
    docs = streaming.document_stream(spark, f"{sf_dir}/documents.parque[t]", "text string")
    streaming.start(streaming.new_words(docs, "text"), f"{folder}/words", f"{folder}/state").awaitTermination()
    return spark.read.schema("word string").parquet(f"{folder}/words")


@_query(f"WITH {_PAGES_CLEAN} SELECT page_id, 'utf-8' AS codec, text, text = '' AS empty, CAST(NULL AS VARCHAR) AS error FROM clean")
def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as files, then listed, read, decoded and cleaned from there."""
    folder = shared_folder.local(shared_folder.fresh(spark, "corpus"))
    named = _table(spark, sf_dir, "pages").select(F.format_string("%08d.html", "page_id").alias("name"), F.col("html").alias("text"))
    sinks.write_texts(named, folder).where("error is not null").count()
    out = flows.strip_bytes(flows.read_documents(spark, folder))
    page = F.regexp_extract("path", r"([0-9]+)\.html$", 1).cast("long").alias("page_id")
    return out.select(page, "codec", "text", "empty", "error")


def _written(spark: SparkSession, sf_dir: str, names: str, tag: str) -> str:
    """A folder of files, one for each page, called as the SQL expression says."""
    folder = shared_folder.local(shared_folder.fresh(spark, tag))
    named = _texts(spark, sf_dir, "pages", "page_id", "html").select(F.expr(names).alias("name"), F.col("html").alias("text"))
    sinks.write_texts(named, folder).where("error is not null").count()
    return folder


@_query(
    """SELECT printf('%08d', page_id) || CASE WHEN page_id % 4 = 0 THEN '.html' ELSE '.HTM' END AS name, octet_length(encode(html)) AS bytes_read,
    CAST(NULL AS VARCHAR) AS error FROM pages WHERE page_id % 4 < 2"""
)
def flat_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written under four suffixes, listed flat and opened: two of the suffixes count."""
    names = "concat(format_string('%08d', page_id), element_at(array('.html', '.HTM', '.txt', '.xhtml'), cast(page_id % 4 + 1 as int)))"
    opened = flows.open_files(spark, _written(spark, sf_dir, names, "flat"))
    return opened.select(paths.base_name(F.col("path")).alias("name"), "bytes_read", "error")


_MOST = 4000


@_query(
    f"""SELECT page_id, CASE WHEN size <= {_MOST} THEN size ELSE 0 END AS length, CASE WHEN size > {_MOST} THEN 'excede el limite (' || size || ' > {_MOST})' END AS error
    FROM (SELECT page_id, octet_length(encode(html)) AS size FROM pages)"""
)
def read_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as files and read under a size limit: what is larger is a row with an error."""
    folder = _written(spark, sf_dir, "format_string('%08d.xhtml', page_id)", "limited")
    page = F.regexp_extract("path", r"([0-9]+)\.xhtml$", 1).cast("long").alias("page_id")
    return flows.read_documents(spark, folder, max_bytes=_MOST).select(page, "length", "error")


@_query(f"{_DOC_WORDS}, p AS ({_POSITIONS}) SELECT pos AS line_no, word AS line FROM p")
def word_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted vocabulary written to one file, and its lines read back."""
    path = shared_folder.local(shared_folder.fresh(spark, "words"))
    sinks.write_lines(vocab.sorted_vocabulary(_texts(spark, sf_dir, "documents", "text"), "text"), "word", path)
    return logs.read_lines(spark, f"file://{path}")


# --- Paths, predicates, guards ---

_URL_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || CASE WHEN page_id % 3 = 0 THEN chr(10) ELSE '' END"


def _url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    # Some end in a line break, which is no part of a suffix.
    path = F.concat(path, F.when(F.col("page_id") % 3 == 0, F.lit("\n")).otherwise(F.lit("")))
    return _table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@_query(
    rf"""SELECT page_id, path, regexp_matches(lower(path), '[^/]\.html?\z') AS is_html, regexp_matches(lower(path), '\.(?:html?|xhtml)\z') AS is_markup,
    starts_with(path, 'blog.') AS is_blog FROM (SELECT page_id, {_URL_PATH} AS path FROM pages)"""
)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _url_paths(spark, sf_dir).select("page_id", "path", paths.is_html(path).alias("is_html"), paths.is_markup(path).alias("is_markup"), F.startswith(path, F.lit("blog.")).alias("is_blog"))


@_query(
    rf"""SELECT page_id, replace(regexp_replace(path, '([^/.])\.[^./]*\z', '\1'), '/', '_') || '.txt' AS name, 'corpus/' || path AS short
    FROM (SELECT page_id, {_URL_PATH} AS path FROM pages)"""
)
def output_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _url_paths(spark, sf_dir).select("page_id", paths.output_name(path).alias("name"), paths.short_name(path, F.lit("/data/corpus")).alias("short"))


@_query("SELECT name, count(*) AS documents FROM (SELECT 'd' || page_id % 7 || '_' || page_id % 10 || '.txt' AS name FROM pages) GROUP BY name HAVING count(*) > 1")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that documents share: equal paths under other suffixes, and paths that differ only in a slash."""
    between = F.when(F.col("page_id") % 2 == 0, F.lit("/")).otherwise(F.lit("_"))
    suffix = F.when(F.col("page_id") % 3 == 0, F.lit(".htm")).otherwise(F.lit(".html"))
    path = F.concat(F.lit("d"), F.col("page_id") % 7, between, F.col("page_id") % 10, suffix)
    return sinks.collisions(_table(spark, sf_dir, "pages").select(paths.output_name(path).alias("name")))


_LIMIT = 4000


@_query(
    f"""SELECT doc_id, length(text) AS chars, octet_length(encode(text)) AS bytes,
    CASE WHEN length(text) > {_LIMIT} THEN 'texto demasiado largo (' || length(text) || ' caracteres)' END AS error FROM documents"""
)
def size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select(
        "doc_id", F.char_length(text).cast("long").alias("chars"), F.octet_length(text).cast("long").alias("bytes"), cleaning.clean_error(text, _LIMIT).alias("error")
    )


_BLANK = "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN chr(9) || ' ' || chr(8195) || chr(10) WHEN 2 THEN '12 3.4 _' WHEN 3 THEN NULL ELSE text END"


@_query(
    f"""SELECT doc_id, coalesce(NOT regexp_matches(text, '{_LETTERS}'), true) AS wordless, coalesce(trim(replace(replace(text, chr(8195), ''), chr(9), ''), ' ' || chr(10)), '') = '' AS empty
    FROM (SELECT doc_id, {_BLANK} AS text FROM documents)"""
)
def empty_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, four fifths of them replaced by texts that are empty, blank, without words or null."""
    kind, text = F.col("doc_id") % 5, F.col("text")
    docs = _texts(spark, sf_dir, "documents", "doc_id", "text").withColumn(
        "text", F.when(kind == 0, "").when(kind == 1, "\t \u2003\n").when(kind == 2, "12 3.4 _").when(kind == 3, None).otherwise(text)
    )
    return docs.select("doc_id", F.coalesce(F.size(words(text)) <= 0, F.lit(True)).alias("wordless"), cleaning.is_empty(text).alias("empty"))


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select(
        F.format_string("src/%06d.html", "doc_id").alias("path"), (F.char_length(text) / 1e6).alias("seconds"),
        cleaning.is_empty(text).alias("empty"), cleaning.clean_error(text, _LIMIT).alias("error"),
    )


_SQL_LIMITED = f"""l AS (SELECT format('src/{{:06d}}.html', doc_id) AS path, length(text) / 1e6 AS seconds, trim(text) = '' AS empty,
    CASE WHEN length(text) > {_LIMIT} THEN 'texto demasiado largo (' || length(text) || ' caracteres)' END AS error FROM documents)"""


@_query(f"WITH {_SQL_LIMITED} SELECT count(*) AS files, count(error) AS errors, count(*) FILTER (empty) AS empty, count(*) - count(error) AS ok FROM l")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_counts(_limited(spark, sf_dir))


@_query(f"WITH {_SQL_LIMITED} SELECT path, error FROM l WHERE error IS NOT NULL")
def failed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failures(_limited(spark, sf_dir)).select("path", "error")


# --- Aggregates, order, report lines ---

_SIZES = "s AS (SELECT page_id, octet_length(encode(html)) AS bytes FROM pages)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"))


@_query(f'WITH {_SIZES} SELECT min(bytes) AS "min", max(bytes) AS "max", round(avg(bytes), 6) AS "avg", CAST(sum(bytes) AS BIGINT) AS "sum" FROM s')
def size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.size_stats(_sizes(spark, sf_dir), F.col("bytes")).withColumn("avg", F.round("avg", 6))


@_query(f"WITH {_SIZES} SELECT CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) / 1024.0 / 1024.0, 9) AS mib FROM s")
def bytes_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mebibytes(_sizes(spark, sf_dir), F.col("bytes")).withColumn("mib", F.round("mib", 9))


@_query(f"WITH {_SIZES} SELECT page_id % 10 AS worker, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS total, round(avg(bytes), 6) AS mean FROM s GROUP BY 1")
def partition_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_worker(_sizes(spark, sf_dir), F.col("page_id") % 10, F.col("bytes")).withColumn("mean", F.round("mean", 6))


@_query(
    f"""WITH {_SIZES}, g AS (SELECT page_id % 10 AS worker, sum(bytes) / 1e6 AS cpu FROM s GROUP BY 1)
    SELECT round(greatest(0.0, 1.5 * max(cpu) - sum(cpu) / count(*) - 0.01), 9) AS overhead FROM g"""
)
def dispatch_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = reports.by_worker(_sizes(spark, sf_dir), F.col("page_id") % 10, F.col("bytes") / 1e6)
    cpu = F.col("total")
    return groups.agg(F.round(reports.overhead(1.5 * F.max(cpu), F.sum(cpu), F.count("*"), F.lit(0.01)), 9).alias("overhead"))


@_query(f"WITH {_SIZES} SELECT page_id, bytes, row_number() OVER (ORDER BY bytes DESC, page_id) AS place FROM s ORDER BY place LIMIT 10")
def largest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = reports.largest_first(_sizes(spark, sf_dir), "bytes", "page_id").limit(10)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("bytes"), "page_id")).cast("long"))


_LOG = "g AS (SELECT page_id + 1 AS line_no, format('{:03d}.html', page_id) || '   ' || format('{:.6f}', length(html) / 1e6) AS line FROM pages)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.format_string("%03d.html", "page_id"), F.lit("   "), formats.seconds(F.length("html") / 1e6))
    return _table(spark, sf_dir, "pages").select((F.col("page_id") + 1).alias("line_no"), line.alias("line"))


@_query(f"WITH {_LOG} SELECT row_number() OVER (ORDER BY line_no) AS line_no, line FROM g")
def log_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written to one file, and its lines read back."""
    path = shared_folder.local(shared_folder.fresh(spark, "log"))
    sinks.write_lines(_log(spark, sf_dir).orderBy("line_no"), "line", path)
    return logs.read_lines(spark, f"file://{path}")


@_query(f"WITH {_LOG} SELECT line_no, line FROM g ORDER BY line_no LIMIT 4")
def head_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.head(_log(spark, sf_dir), 4)


@_query(f"WITH {_LOG} SELECT line_no, line FROM g ORDER BY line_no DESC LIMIT 5")
def tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.tail(_log(spark, sf_dir), 5)


@_query(f"WITH {_LOG} SELECT line_no, string_split(line, ' ')[1] AS path, CAST(regexp_extract(line, ' ([0-9.]+)$', 1) AS DOUBLE) AS seconds FROM g")
def log_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.timings(_log(spark, sf_dir))


@_query("SELECT key, value FROM (VALUES ('archivos', '505'), ('procesos', '10'), ('tiempo total', '0.379278'), ('modo', 'x:y'), ('002.html', '3')) t(key, value)")
def log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame(
        [(1, "001.html   0.1"), (2, "archivos: 504 ok"), (3, "procesos:   10"), (4, "tiempo total: 0.379278 s"), (5, "sin par"), (6, "modo: x:y z"), (7, "archivos: 505"), (8, "002.html: 3")],
        "line_no long, line string",
    )
    return logs.totals(lines)


_SECONDS = "t AS (SELECT length(html) / 1e6 AS seconds, length(url) / 1e6 AS clean_seconds, CASE WHEN page_id % 3 > 0 THEN (page_id % 11) / 1e6 END AS word_seconds FROM pages)"


def _staged_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of three stages for each page, made of its lengths; some documents never reach the last."""
    return _table(spark, sf_dir, "pages").select(
        (F.length("html") / 1e6).alias("seconds"), (F.length("url") / 1e6).alias("clean_seconds"),
        F.when(F.col("page_id") % 3 > 0, (F.col("page_id") % 11) / 1e6).alias("word_seconds"),
    )


@_query(f"WITH {_SECONDS} SELECT round(sum(seconds), 6) AS seconds, round(sum(clean_seconds), 6) AS clean_seconds, round(sum(word_seconds), 6) AS word_seconds FROM t")
def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["seconds", "clean_seconds", "word_seconds"]
    return reports.stage_seconds(_staged_seconds(spark, sf_dir), names).select(*(F.round(c, 6).alias(c) for c in names))


@_query(
    f"""WITH {_SECONDS}, r AS (SELECT round(sum(seconds), 6) AS a, round(sum(clean_seconds), 6) AS b, round(sum(word_seconds), 6) AS c FROM t)
    SELECT round(a / b, 6) AS ratio, round(b + c, 6) AS together FROM r"""
)
def phase_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars derived from the totals of a log, as its lines say them."""
    sums = reports.stage_seconds(_staged_seconds(spark, sf_dir), ["seconds", "clean_seconds", "word_seconds"])
    line = lambda k, name, c: F.struct(F.lit(k).alias("line_no"), F.concat(F.lit(f"  {name}: "), formats.seconds(F.col(c)), F.lit(" s")).alias("line"))
    lines = sums.select(F.explode(F.array(line(1, "fase", "seconds"), line(2, "union", "clean_seconds"), line(3, "orden", "word_seconds"))).alias("x")).select("x.*")
    out = reports.phase_scalars(logs.totals(lines, first_token=False), "fase", "union", ["union", "orden"])
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


_SQL_PAD = "path || repeat(' ', greatest(width - length(path), 0)) || '  '"


@_query(
    f"""WITH {_SQL_LIMITED}, w AS (SELECT max(length(path)) AS width FROM l)
    SELECT path, {_SQL_PAD} || lpad(format('{{:.6f}}', seconds), 12, ' ') || coalesce('  ERROR: ' || error, '') AS line FROM l, w"""
)
def fixed_width_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.open_log(_limited(spark, sf_dir))


@_query(
    f"""WITH {_SQL_LIMITED}, w AS (SELECT greatest(max(length(path)), 24) AS width FROM l)
    SELECT CAST(error IS NOT NULL AS INTEGER) AS part, path, {_SQL_PAD} || lpad(CASE WHEN error IS NULL THEN format('{{:.6f}}', seconds) ELSE 'ERROR' END, 12, ' ')
    || coalesce('  (' || error || ')', '') AS line FROM l, w"""
)
def timing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.timing_report(_limited(spark, sf_dir))


@_query(
    """WITH s AS (SELECT 'documents' AS run, count(*) AS files, sum(length(text)) AS chars FROM documents
    UNION ALL SELECT 'conversations', count(*), sum(length(text)) FROM conversations UNION ALL SELECT 'benchmark', count(*), sum(length(text)) FROM benchmark)
    SELECT m AS metric, CAST(max(v) FILTER (run = 'documents') AS BIGINT) AS documents, CAST(max(v) FILTER (run = 'conversations') AS BIGINT) AS conversations,
    CAST(max(v) FILTER (run = 'benchmark') AS BIGINT) AS benchmark FROM (SELECT run, 'files' AS m, files AS v FROM s UNION ALL SELECT run, 'chars', chars FROM s) GROUP BY m"""
)
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ["documents", "conversations", "benchmark"]
    each = [
        _table(spark, sf_dir, t).agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars")).select(F.lit(t).alias("run"), F.stack(F.lit(2), F.lit("files"), "files", F.lit("chars"), "chars").alias("metric", "value"))
        for t in runs
    ]
    return reports.compare_runs(each[0].unionByName(each[1]).unionByName(each[2]), runs)


@_query("SELECT doc_id, regexp_replace(substr(text, 1, 420), '\\A\\s+|\\s+\\z', '', 'g') AS excerpt FROM documents")
def text_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", cleaning.strip(F.substring("text", 1, 420)).alias("excerpt"))


_CHARSETS = ["utf-8", "utf8", "latin1", "windows-1251", "x-other"]
_SQL_CHARSET = "CASE page_id % 5 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_CHARSETS)) + " END"


@_query(
    f"""WITH d AS (SELECT page_id, {_SQL_CHARSET} AS declared, page_id % 5 = 4 AND regexp_matches(html, '[^\\x00-\\x7f]') AS single FROM pages)
    SELECT page_id, declared, CASE WHEN declared = 'latin1' OR single THEN 'cp1252' ELSE 'utf-8' END AS codec, CASE WHEN page_id % 5 < 3 THEN 'meta charset=' || declared
    ELSE 'meta ' || chr(39) || declared || chr(39) || ' rechazado -> ' || CASE WHEN single THEN 'cp1252' ELSE 'utf-8' END END AS reason FROM d"""
)
def page_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that declare a known name, an alias or an unknown one; some of the last in single bytes."""
    names = F.element_at(F.array(*map(F.lit, _CHARSETS)), (F.col("page_id") % 5 + 1).cast("int"))
    html = F.regexp_replace("html", F.lit('charset="?utf-8'), F.concat(F.lit('charset="'), names))
    pages = _texts(spark, sf_dir, "pages", "page_id", "html").withColumn("html", html)
    content = F.when(F.col("page_id") % 5 == 4, F.encode("html", "ISO-8859-1")).otherwise(F.col("html").cast("binary"))
    found = decoding.detect(F.col("content"))
    return pages.select("page_id", content.alias("content")).select(
        "page_id", decoding.declared_charset(F.col("content")).alias("declared"), found["codec"].alias("codec"), found["reason"].alias("reason")
    )


# --- Literal rows, their results derived by hand from the rules ---


def _literal(value: str | None) -> str:
    if value is None:
        return "CAST(NULL AS VARCHAR)"
    return " || ".join(f"chr({ord(c)})" if c in "\n\t\0" else "'" + c.replace("'", "''") + "'" for c in value) if value else "''"


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(str(x) if isinstance(x, int) else _literal(x) for x in r) + ')' for r in rows)}) t({names})"


DECODED = [
    (0, b"", "", "vacio"), (1, b"\xef\xbb\xbfA", "A", "utf-8-sig"), (2, b"\xff\xfeA\0", "A", "utf-16-le"),
    (3, b"\xff\xfe\0\0A\0\0\0", "A", "utf-32-le"), (4, b"\xc3\xa9", "é", "utf-8"), (5, b"\xe9\x80", "é€", "cp1252"),
    (6, b"<meta charset=iso-8859-1>\x93", "<meta charset=iso-8859-1>“", "cp1252"),
    (7, b"<meta charset=utf-7>+ADw-b+AD4-", "<meta charset=utf-7>+ADw-b+AD4-", "utf-8"),
    (8, b"<meta charset=windows-1251>\xe9", "<meta charset=windows-1251>é", "cp1252"),
    (9, b"<meta charset=utf-8>\xff", "<meta charset=utf-8>�", "utf-8"),
    (10, b"a\xe2\x80\x8bb\xe2\x80\xa8c", "ab\nc", "utf-8"),
    (11, b'<META http-equiv=x content="text/html; charset=Shift_JIS">\x82\xa0', '<META http-equiv=x content="text/html; charset=Shift_JIS">あ', "shift_jis"),
    (12, b"<meta charset='koi8-r'>\xc1", "<meta charset='koi8-r'>а", "koi8-r"),
]


@_query(_values([(k, text, None, codec) for k, _, text, codec in DECODED], "id, text, error, codec"))
def decode_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k, bytearray(c)) for k, c, _, _ in DECODED], "id int, content binary")
    return rows.select("id", decoding.decode(F.col("content")).alias("d")).select("id", "d.text", "d.error", "d.codec")


INLINE = [
    (0, "<b>ne</b><i>gri</i><u>ta</u>", "negrita"), (1, "<p>uno</p><p>dos</p>", "uno\n\ndos"), (2, "<span>1</span><span>2</span>", "12"),
    (3, "<!DOCTYPE html>x", "x"), (4, "&lt;p&gt;esto no es un tag&lt;/p&gt;", "<p>esto no es un tag</p>"), (5, "&amp;lt;", "&lt;"),
    (6, "&#x80;&copy x", "€© x"), (7, "a\0b\tc", "ab c"), (8, "a<!-- <p>x</p> -->b", "a\nb"), (9, 'a<script>var t="</p>";</script>b', "a\nb"),
    (10, "", ""),
]
BROKEN = [
    (0, '<TD ALIGN="left"><CHAMBERLAIN</TD>  <TD ALIGN="right">70</TD>', "70"), (1, '<A NAME=HeadList"></A>x', "x"),
    (2, '<span title="a>b">z</span>', "z"), (3, '<a title="rota>texto</a>', "texto"), (4, "si a<b y c>d", "si ad"),
    (5, "si 3 < 4 y 5 > 2", "si 3 < 4 y 5 > 2"), (6, "a<style>x", "a"), (7, "a<noscript>x", "ax"), (8, "texto <a href=", "texto"),
    (9, "<p:x>a</p-x>b</ p>c", "a\nbc"), (10, "x<![CDATA[y]]>z", "xz"),
]
PREFORMATTED = [
    (0, "<p>A  b</p><pre>  k   &lt;b&gt;\n  <b>z</b><br>q</pre> c", "A b\n\n  k   <b>\n  z\nq\nc"), (1, "<pre>open   end", "open   end"),
    (2, "<pre>a<xmp>b</xmp>c</pre>", "a\nb\nc"), (3, "x<pre>a\n\n\n\nb</pre>", "x\na\n\nb"), (4, "<PRE class='a>b'> i </PRE >j", "i \nj"),
]
RAW = [
    (0, "<xmp><b>x</b> &lt;</xmp>", "<b>x</b> &lt;"), (1, "a<plaintext><b>x", "a\n<b>x"), (2, "a<listing>  k  <p></xmp>b", "a\n  k  <p>\nb"),
    (3, "<xmp>a<pre>b</xmp>c", "a<pre>b\nc"),
]


def _cleaned(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    sources = spark.createDataFrame([(k, source) for k, source, _ in rows], "id int, html string")
    return sources.select("id", cleaning.clean(F.col("html"))["text"].alias("text"))


def _expected(rows: list[tuple]) -> str:
    return _values([(k, text) for k, _, text in rows], "id, text")


@_query(_expected(INLINE))
def markup_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, INLINE)


@_query(_expected(BROKEN))
def broken_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, BROKEN)


@_query(_expected(PREFORMATTED))
def pre_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, PREFORMATTED)


@_query(_expected(RAW))
def raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, RAW)


ORDERED = ["kozben", "közben", "kozbeo", "øb", "ßa", "zz"]


@_query(_values([(w, k + 1) for k, w in enumerate(ORDERED)], "word, pos"))
def order_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(w,) for w in reversed(ORDERED)], "word string")
    return vocab.with_positions(rows)
