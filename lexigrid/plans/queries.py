"""One query per operator of the catalog, over its whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as fx
from ..operators import collections as coll, fts, index, search
from ..operators.objects import extracted, live_objects, object_rows, objects_text
from ..sources.files import content_hash, folders, parsed
from ..sources.shared import shared_folder
from ..sources.store import Store
from ..sources.tables import table
from ..streaming import watch
from . import catalog as cat
from .spread import spread
from .stored import TableFiles, as_files, stored

QUERIES: dict = {}
SQL: dict[str, str] = {}
TODAY = "2026-06-15"
DAY = "12/03/2024"

# -- the catalog in SQL -----------------------------------------------------------
_UP, _LO = fx.UPPER, fx.LOWER
_SRC, _DST = fx.accent_table()
_TOK = "regexp_extract_all(regexp_replace(translate(lower(coalesce({0}, '')), '" + _SRC + "', '" + _DST + r"'), '\p{{Mn}}+', '', 'g'), '[\p{{L}}\p{{N}}\p{{Co}}]+')"
_CTE = f"""
q AS (SELECT DISTINCT * FROM queries),
links AS (SELECT DISTINCT query_id, lower(trim(name)) AS tag FROM query_tags JOIN tags ON tag_id = tags.id WHERE trim(name) <> ''),
objs AS (SELECT query_id, object_type, translate(object_name, '{_UP}', '{_LO}') AS object_key, min(object_name) AS object_name FROM query_objects
         WHERE object_type IN ('table', 'column', 'procedure', 'function') AND object_name IS NOT NULL AND object_name <> '' GROUP BY ALL),
favs AS (SELECT DISTINCT project, rel_path FROM favorites),
views AS (SELECT project, rel_path, coalesce(try_strptime(viewed_at[1:26], '%Y-%m-%dT%H:%M:%S.%f'), try_strptime(viewed_at, '%Y-%m-%d %H:%M:%S')) AS viewed_at FROM recently_viewed),
ftsrows AS (SELECT q.project, q.id AS query_id, q.title, coalesce(q.description, '') AS description, q.body, coalesce(o.objects, '') AS objects
        FROM q LEFT JOIN (SELECT query_id, string_agg(object_name, ' ' ORDER BY CASE object_type WHEN 'table' THEN 0 ELSE 1 END, object_name) AS objects
                          FROM objs WHERE object_type IN ('table', 'column') GROUP BY query_id) o ON o.query_id = q.id)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {_CTE}\n{sql.strip()}"
        return f

    return add


# -- ingest -------------------------------------------------------------------------
_STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', ''), '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+$', '')"


_STEM = r"regexp_replace(regexp_replace(rel_path, '^.*/', ''), '\.sql$', '')"


@query(
    f"""SELECT project, rel_path, coalesce(nullif(title, ''), {_STEM}) AS title, {_STRIP.format("coalesce(description, '')")} AS description, length({_STRIP.format('body')}) AS body_length, true AS has_frontmatter,
'utf-8' AS encoding, octet_length(encode(body)) > 0 AS has_body FROM q"""
)
def s_parse_files(spark: SparkSession, d: str) -> DataFrame:
    """Files with a front matter are decoded, split and projected; a file without a title is named by its path."""
    out = parsed(as_files(cat.queries(spark, d)))
    return out.select("project", "rel_path", "title", "description", F.length("body").alias("body_length"), "has_frontmatter", "encoding", (F.length("body") > 0).alias("has_body"))


# Bodies as five kinds of bytes; cp1252 only where its bytes can't be read as UTF-8.
_KIND = r"CASE id % 5 WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16-le' WHEN 3 THEN 'utf-16-be' ELSE CASE WHEN id % 5 = 4 AND {0} AND NOT {1} AND NOT {2} THEN 'cp1252' ELSE 'utf-8' END END"
_KINDS = (r"[^\x00-\x7F]", r"[^\x00-\x7F\xA0-\xFF]", r"[\xC2-\xF4][\xA0-\xBF]")


@query(
    f"""SELECT id, CASE WHEN own AND kind = 'utf-8' THEN 'utf-8-sig' ELSE kind END AS encoding, kind LIKE 'utf-%-%' OR own AND kind = 'utf-8' AS had_bom,
md5({_STRIP.format("CASE WHEN own AND kind = 'utf-8' THEN substr(body, 2) ELSE body END")}) AS body
FROM (SELECT id, body, starts_with(body, chr(65279)) AS own, {_KIND.format(*[f"regexp_matches(body, '{k}')" for k in _KINDS])} AS kind FROM q)"""
)
def s3_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Bytes with and without a byte order mark, in four encodings, are told apart and decoded."""
    kind = F.expr(_KIND.format(*[f"body RLIKE r'{k}'" for k in _KINDS]))
    mark = lambda b, name: F.concat(F.lit(bytearray(b)), F.encode("body", name))
    content = (
        F.when(kind == "utf-8-sig", mark(b"\xef\xbb\xbf", "UTF-8")).when(kind == "utf-16-le", mark(b"\xff\xfe", "UTF-16LE")).when(kind == "utf-16-be", mark(b"\xfe\xff", "UTF-16BE"))
        .when(kind == "cp1252", F.encode("body", "ISO-8859-1")).otherwise(F.encode("body", "UTF-8"))
    )
    files = cat.queries(spark, d).select("project", F.col("id").cast("string").alias("rel_path"), "file_mtime", "file_size", content.alias("content"))
    return parsed(files).select(F.col("rel_path").cast("long").alias("id"), "encoding", "had_bom", F.md5("body").alias("body"))


@query("SELECT project, count(*) AS files, sum(octet_length(encode(body))) AS bytes, min(sha256(body)) AS first_hash FROM q GROUP BY project")
def s8_file_stats(spark: SparkSession, d: str) -> DataFrame:
    """Size in bytes and SHA-256 of each text."""
    q = cat.queries(spark, d).select("id", "project", content_hash(F.encode("body", "UTF-8")).alias("h"), F.octet_length("body").cast("long").alias("n"))
    return q.groupBy("project").agg(F.count("*").alias("files"), F.sum("n").alias("bytes"), F.min("h").alias("first_hash"))


@query("SELECT DISTINCT project, unnest(list_transform(range(1, len(p)), lambda k: array_to_string(p[1:k], '/'))) AS folder FROM (SELECT project, string_split(rel_path, '/') AS p FROM q)")
def s14_subfolders(spark: SparkSession, d: str) -> DataFrame:
    """Every folder on the way to a file."""
    return folders(table(spark, d, "queries").select("project", "rel_path"))


# -- extraction ---------------------------------------------------------------------
@query()
def x1_extract_objects(spark: SparkSession, d: str) -> DataFrame:
    """Names in each body and their text for the full-text index."""
    rows = spread(table(spark, d, "queries").select("id", "body")).select("id", extracted("body").alias("o"))
    one = [F.array_join(f"o.{k}", " ").alias(k + "s") for k in ("table", "column", "alias")]
    return rows.select("id", *one, objects_text(F.col("o")).alias("objects_text")).dropDuplicates(["id"])


@query()
def x_object_rows(spark: SparkSession, d: str) -> DataFrame:
    """X1 with I8: rows of the object table from the bodies."""
    return object_rows(spread(table(spark, d, "queries").select("project", "id", "body")).select("project", "id", extracted("body").alias("objects")))


_BOTH = "(SELECT query_id FROM objs WHERE object_type = 'table') INTERSECT (SELECT query_id FROM objs WHERE object_type = 'column')"


@query(f"SELECT query_id, object_type, object_key, object_name FROM objs WHERE object_type IN ('table', 'column') AND query_id IN ({_BOTH})")
def x1_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Names that are written into a query as quoted tables, with schemas and aliases in turn, and as columns come out of it again."""
    names = cat.objects(spark, d).where(F.col("object_type").isin("table", "column"))
    quoted = F.concat(F.lit("["), F.replace("object_name", F.lit("]"), F.lit("]]")), F.lit("]"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("object_type") == kind, quoted)))
    rows = names.groupBy("query_id").agg(of("table").alias("t"), of("column").alias("c")).where("size(t) > 0 AND size(c) > 0")
    form = lambda t, i: F.when(i % 3 == 0, t).when(i % 3 == 1, F.concat(F.lit("dbo."), t)).otherwise(F.concat(t, F.lit(" AS x"), i.cast("string")))
    body = F.concat(F.lit("SELECT "), F.array_join("c", ", "), F.lit(" FROM "), F.array_join(F.transform("t", form), " CROSS JOIN "))
    out = rows.select(F.lit("").alias("project"), F.col("query_id").alias("id"), extracted(body).alias("objects"))
    return object_rows(out).select("query_id", "object_type", "object_key", "object_name")


@query()
def x9_live_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of each file, which the index doesn't keep."""
    out = live_objects(spread(table(spark, d, "queries").select("project", "id", "body")))
    return out.select("id", F.array_join("alias", " ").alias("aliases")).dropDuplicates(["id"])


# -- index maintenance ----------------------------------------------------------------
_OLD = "(SELECT project, rel_path, id, file_mtime, content_hash FROM q WHERE id % 7 <> 3)"
_NEW = "(SELECT project, rel_path, id, CASE WHEN id % 10 < 3 THEN file_mtime + 60 ELSE file_mtime END AS file_mtime, CASE WHEN id % 10 = 1 THEN 'changed' ELSE content_hash END AS content_hash FROM q WHERE id % 10 <> 0)"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two states of all files: later some are gone, new, changed or touched."""
    q = cat.queries(spark, d).select("project", "rel_path", "id", "file_mtime", "content_hash")
    new = q.where("id % 10 <> 0").withColumn("content_hash", F.when(F.expr("id % 10 = 1"), "changed").otherwise(F.col("content_hash")))
    return new.withColumn("file_mtime", F.when(F.expr("id % 10 < 3"), F.col("file_mtime") + 60).otherwise(F.col("file_mtime"))), q.where("id % 7 <> 3")


@query(
    f"""SELECT coalesce(n.project, o.project) AS project, coalesce(n.rel_path, o.rel_path) AS rel_path,
CASE WHEN n.id IS NULL THEN 'delete' WHEN o.id IS NULL THEN 'insert' WHEN n.file_mtime IS NOT DISTINCT FROM o.file_mtime THEN 'skip'
WHEN n.content_hash IS NOT DISTINCT FROM o.content_hash THEN 'touch' ELSE 'replace' END AS action
FROM {_NEW} n FULL OUTER JOIN {_OLD} o ON n.project = o.project AND n.rel_path = o.rel_path"""
)
def i2_diff_actions(spark: SparkSession, d: str) -> DataFrame:
    return index.diff(*_versions(spark, d)).select("project", "rel_path", "action")


@query(f"SELECT project, rel_path, file_mtime, content_hash FROM {_NEW} UNION ALL SELECT project, rel_path, file_mtime, content_hash FROM {_OLD} o WHERE NOT EXISTS (SELECT 1 FROM {_NEW} n WHERE n.project = o.project AND n.rel_path = o.rel_path)")
def i4_upsert(spark: SparkSession, d: str) -> DataFrame:
    new, old = _versions(spark, d)
    return index.upsert(old.drop("id"), new.drop("id"), index.KEY)


_TIMES = "CASE WHEN id % 10 < 3 THEN coalesce(file_mtime, 0) + 60 ELSE coalesce(file_mtime, 0) END"
_BODIES = "CASE WHEN id % 10 = 1 THEN body || ' -- changed' ELSE body END"


@query(f"SELECT project, rel_path, {_TIMES} AS file_mtime, md5({_STRIP.format(_BODIES)}) AS body FROM q WHERE id % 10 <> 0")
def i1_refresh(spark: SparkSession, d: str) -> DataFrame:
    """An index that was built from a first state of all files and refreshed with a second has the files of the second."""
    q = cat.queries(spark, d).select("project", "rel_path", "id", "title", "description", "body", "file_mtime")
    new = q.where("id % 10 <> 0").withColumns({"file_mtime": F.expr(_TIMES), "body": F.expr(_BODIES)})
    store = Store(spark, shared_folder(spark))
    projects = sorted(r[0] for r in q.select("project").distinct().collect())
    index.rebuild(store, TableFiles(as_files(q.where("id % 7 <> 3")), projects))
    index.refresh(store, TableFiles(as_files(new), projects))
    return store.read("queries").select("project", "rel_path", "file_mtime", F.md5("body").alias("body"))


@query("SELECT l.query_id, l.tag FROM links l WHERE l.query_id NOT IN (SELECT q.id FROM q JOIN favs USING (project, rel_path))")
def i5_delete(spark: SparkSession, d: str) -> DataFrame:
    """Links that are left when all favorite files are deleted."""
    tables = {"queries": cat.queries(spark, d), "query_tags": cat.with_project(spark, d, cat.links(spark, d))}
    return index.delete(tables, cat.favorites(spark, d))["query_tags"].select("query_id", "tag")


@query("SELECT q.project, q.rel_path, l.tag FROM links l JOIN q ON q.id = l.query_id")
def i6_tag_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that come of the tags in front matters."""
    tags = search.tags_of(cat.links(spark, d)).withColumnRenamed("query_id", "id")
    out = index.expand(as_files(cat.queries(spark, d).join(tags, "id", "left"), True))
    return out["query_tags"].join(out["queries"].select(F.col("id").alias("query_id"), "rel_path"), "query_id").select("project", "rel_path", "tag")


@query("SELECT DISTINCT q.project, l.tag FROM links l JOIN q ON q.id = l.query_id")
def i7_tag_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return index.vocabulary(cat.with_project(spark, d, cat.links(spark, d)))


@query("SELECT query_id, object_type, object_name, object_key FROM objs")
def i8_stored_objects(spark: SparkSession, d: str) -> DataFrame:
    return cat.objects(spark, d)


@query("SELECT query_id, objects FROM ftsrows")
def i9_fts_objects(spark: SparkSession, d: str) -> DataFrame:
    return cat.fts(spark, d).select("query_id", "objects").distinct()


# -- search strings ---------------------------------------------------------------------
_TEXT = "'table:' || coalesce(title, '') || ' tag:' || dialect || ' ' || coalesce(description, '') || ' date:' || coalesce(created_at, '-')"
_GAP = r"[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]".replace("{{", "{").replace("}}", "}")
_FIND = rf"(^|{_GAP})(table|col|tag|date):([^{_GAP[1:-1]}]+)"


def _search_text() -> Column:
    return F.concat(F.lit("table:"), F.coalesce("title", F.lit("")), F.lit(" tag:"), "dialect", F.lit(" "), F.coalesce("description", F.lit("")), F.lit(" date:"), F.coalesce("created_at", F.lit("-")))


@query(
    f"""SELECT id, array_to_string(list_transform(list_filter(list_zip(regexp_extract_all(t, '{_FIND}', 2), regexp_extract_all(t, '{_FIND}', 3)), lambda p: p[1] = 'tag'), lambda p: p[2]), '|') AS tags,
array_to_string(list_transform(list_filter(list_zip(regexp_extract_all(t, '{_FIND}', 2), regexp_extract_all(t, '{_FIND}', 3)), lambda p: p[1] = 'table'), lambda p: p[2]), '|') AS tables
FROM (SELECT id, {_TEXT} AS t FROM q)"""
)
def search_parse(spark: SparkSession, d: str) -> DataFrame:
    """P1 on a column of search strings."""
    p = search.parse_column(_search_text())
    return cat.queries(spark, d).select("id", F.array_join(p["tag"], "|").alias("tags"), F.array_join(p["table"], "|").alias("tables"))


@query(
    r"""SELECT id, CAST(epoch(t) AS BIGINT) AS first_second, CAST(epoch(t) AS BIGINT) + 86399 AS last_second FROM
(SELECT id, CASE WHEN regexp_matches(created_at, '^\d{1,2}/\d{1,2}/\d{4}$') THEN try_strptime(created_at, '%d/%m/%Y') END AS t FROM q)"""
)
def search_day_bounds(spark: SparkSession, d: str) -> DataFrame:
    """P2 on a column of days."""
    lo, hi = search.day_column(F.col("created_at"))
    return cat.queries(spark, d).select("id", lo.alias("first_second"), hi.alias("last_second"))


# -- filters ------------------------------------------------------------------------------
_NAMED = "SELECT query_id FROM objs WHERE object_type = '{0}' AND object_key = '{1}'"
_LO_DAY, _HI_DAY = search.day_bounds(DAY)


def _hits(spark: SparkSession, d: str, text: str) -> DataFrame:
    return search.matching(cat.catalog(spark, d), text)[0].select(F.col("id").alias("query_id"), "rel_path")


@query(f"SELECT id AS query_id, rel_path FROM q WHERE id IN ({_NAMED.format('table', 'kiln')})")
def f1_table_filter(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "table:KILN")


@query(f"SELECT id AS query_id, rel_path FROM q WHERE id IN ({_NAMED.format('column', 'branch_id')})")
def f2_column_filter(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "col:Branch_Id")


@query("SELECT id AS query_id, rel_path FROM q WHERE id IN (SELECT query_id FROM links WHERE tag = 'legacy')")
def f3_tag_filter(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "tag:Legacy")


@query(f"SELECT id AS query_id, rel_path FROM q WHERE file_mtime BETWEEN {_LO_DAY} AND {_HI_DAY}")
def f4_date_filter(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, f"date:{DAY}")


@query(f"SELECT id AS query_id, rel_path FROM q WHERE id IN ({_NAMED.format('column', 'tenant_id')}) AND id IN ({_NAMED.format('table', 'doseaudit')}) AND id IN (SELECT query_id FROM links WHERE tag = 'customer')")
def f5_conjunction(spark: SparkSession, d: str) -> DataFrame:
    """all filters are ANDed; a date that is none is dropped."""
    return _hits(spark, d, "col:tenant_id table:doseaudit tag:customer date:2026-06-15")


@query("SELECT query_id, tables FROM (SELECT query_id, string_agg(object_name, ',' ORDER BY object_name) AS tables FROM objs WHERE object_type = 'table' GROUP BY query_id)")
def f8_tables_list(spark: SparkSession, d: str) -> DataFrame:
    """Tables of each query in one string."""
    return search.tables_of(cat.objects(spark, d)).select("query_id", F.array_join("tables", ",").alias("tables"))


@query("SELECT q.id, f.rel_path IS NOT NULL AS is_favorite FROM q LEFT JOIN favs f USING (project, rel_path)")
def f9_favorite_flag(spark: SparkSession, d: str) -> DataFrame:
    """Whether a file is a favorite."""
    return search.starred(cat.queries(spark, d).select("id", "project", "rel_path"), cat.favorites(spark, d)).select("id", "is_favorite")


@query("SELECT query_id, string_agg(tag, ' ' ORDER BY tag) AS tags FROM links GROUP BY query_id")
def f10_tags_list(spark: SparkSession, d: str) -> DataFrame:
    return search.tags_of(cat.links(spark, d)).select("query_id", F.array_join("tags", " ").alias("tags"))


@query("SELECT id AS query_id, title FROM q WHERE false")
def f7_malformed(spark: SparkSession, d: str) -> DataFrame:
    """a term with a double quote gives no result, with and without a stored index."""
    hits = [search.search(c, 'kiln te"nant').select("query_id", "title") for c in (cat.catalog(spark, d), stored(spark, d))]
    return hits[0].unionByName(hits[1])


_RESULT = """SELECT q.id AS query_id, q.rel_path, q.title, coalesce(q.description, '') AS description, '' AS snippet, 0.0::DOUBLE AS rank, coalesce(t.tags, '') AS tags, q.project AS folder,
coalesce(o.tables, '') AS tables, q.updated_at, f.rel_path IS NOT NULL AS is_favorite, coalesce(q.file_mtime, 0) AS file_mtime
FROM q LEFT JOIN (SELECT query_id, string_agg(tag, ' ' ORDER BY tag) AS tags FROM links GROUP BY query_id) t ON t.query_id = q.id
LEFT JOIN (SELECT query_id, string_agg(object_name, ' ' ORDER BY object_name) AS tables FROM objs WHERE object_type = 'table' GROUP BY query_id) o ON o.query_id = q.id
LEFT JOIN favs f ON f.project = q.project AND f.rel_path = q.rel_path"""


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.array_join("tags", " ")).withColumn("tables", F.array_join("tables", " "))


@query(_RESULT)
def f11_all_results(spark: SparkSession, d: str) -> DataFrame:
    """the empty search gives every file as a full result."""
    return _flat(search.search(cat.catalog(spark, d), ""))


@query("SELECT object_type, string_agg(object_name, ' ' ORDER BY object_name) AS names FROM objs WHERE query_id = 2 GROUP BY object_type")
def f12_objects_of_query(spark: SparkSession, d: str) -> DataFrame:
    m = search.objects_of(cat.objects(spark, d), 2)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("object_type"), F.array_join(k, " ").alias("names")) for k in m.columns])).alias("x")
    return m.select(kinds).select("x.*").where("names <> ''")


@query("SELECT id FROM q WHERE project = 'granary-warehouse' AND rel_path = 'adhoc/routemap_0000005.sql'")
def f13_id_by_path(spark: SparkSession, d: str) -> DataFrame:
    return search.id_of(table(spark, d, "queries"), "granary-warehouse", "adhoc/routemap_0000005.sql")


# -- full text ----------------------------------------------------------------------------
@query(f"SELECT doc_id, len({_TOK.format('text')}) AS tokens, len(list_distinct({_TOK.format('text')})) AS terms FROM documents")
def t1_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = fx.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("terms"))


def _match(phrases: list[list[str]]) -> str:
    """Rank of the rows that match all phrases."""
    count = []
    for p in phrases:
        cells = []
        for c in ("t0", "t1", "t2", "t3"):
            tests = " AND ".join([f"{c}[i + {j}] = '{w}'" for j, w in enumerate(p[:-1])] + [f"starts_with({c}[i + {len(p) - 1}], '{p[-1]}')"])
            cells.append(f"len(list_filter(range(1, len({c}) + {2 - len(p)}), lambda i: {tests}))")
        count.append(" + ".join(cells))
    fs = ", ".join(f"{c} AS f{k}" for k, c in enumerate(count))
    ns = ", ".join(f"count(*) FILTER (f{k} > 0) AS n{k}" for k in range(len(phrases)))
    idf = "CASE WHEN ln((n - n{0} + 0.5) / (n{0} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{0} + 0.5) / (n{0} + 0.5)) END"
    rank = " + ".join(f"({idf.format(k)}) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * d / mean))" for k in range(len(phrases)))
    return f""", toks AS (SELECT project, query_id, {_TOK.format("title")} AS t0, {_TOK.format("description")} AS t1, {_TOK.format("body")} AS t2, {_TOK.format("objects")} AS t3 FROM ftsrows),
counted AS (SELECT project, query_id, len(t0) + len(t1) + len(t2) + len(t3) AS d, {fs} FROM toks),
stats AS (SELECT project, count(*) AS n, avg(d) AS mean, {ns} FROM counted GROUP BY project),
ranked AS (SELECT project, query_id, -({rank}) AS rank FROM counted JOIN stats USING (project) WHERE {" AND ".join(f"f{k} > 0" for k in range(len(phrases)))})"""


def _fts_query(name: str, text: str, doc: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fts.score(cat.fts(spark, d), text).select("project", "query_id", F.round("rank", 6).alias("rank"))

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    SQL[name] = f"WITH {_CTE}{_match(fts.phrases(text))}\nSELECT project, query_id, round(rank, 6) AS rank FROM ranked"


_fts_query("t2_prefix_match", "kil", "T2, T3: one prefix over all projects, with each project's own statistics.")
_fts_query("t2_phrase_match", "kiln_pri", "T2, T3: a phrase of two tokens, the last a prefix.")
_fts_query("t3_bm25", "kiln tenant_id relat", "T3: three terms, ANDed.")


SQL["t3_postings"] = SQL["t3_bm25"]


@query()
def t3_postings(spark: SparkSession, d: str) -> DataFrame:
    """T3 from the stored index: only the token ranges of the search are read."""
    return stored(spark, d).ranked("kiln tenant_id relat").select("project", "query_id", F.round("rank", 6).alias("rank"))


SQL["t2_phrase_postings"] = SQL["t2_phrase_match"]


@query()
def t2_phrase_postings(spark: SparkSession, d: str) -> DataFrame:
    """T2 from the stored index: the tokens of a phrase meet at their place."""
    return stored(spark, d).ranked("kiln_pri").select("project", "query_id", F.round("rank", 6).alias("rank"))


@query()
def t4_snippets(spark: SparkSession, d: str) -> DataFrame:
    """T4: snippets of all hits."""
    out = search.search(stored(spark, d), "kiln tenant_id")
    return out.select("query_id", F.round("rank", 6).alias("rank"), "snippet")


SQL["t5_ranked_search"] = f"""WITH {_CTE}{_match([["kiln"]])}
SELECT r.query_id, q.rel_path, round(r.rank, 6) AS rank FROM ranked r JOIN q ON q.id = r.query_id WHERE r.query_id IN (SELECT query_id FROM links WHERE tag = 'legacy')"""


@query()
def t5_ranked_search(spark: SparkSession, d: str) -> DataFrame:
    """Free text with a tag filter, in the order of rank; statistics come from the whole index."""
    return search.search(stored(spark, d), "tag:legacy kiln").select("query_id", "rel_path", F.round("rank", 6).alias("rank"))


SQL["c7_multi_folder_search"] = f"""WITH {_CTE}{_match([["kiln"]])}
SELECT folder, rel_path, round(rank, 6) AS rank FROM (SELECT q.project AS folder, q.rel_path, r.rank FROM ranked r JOIN q ON q.id = r.query_id AND q.project = r.project ORDER BY round(r.rank, 9), r.query_id LIMIT 50)"""


@query()
def c7_multi_folder_search(spark: SparkSession, d: str) -> DataFrame:
    """One search over all projects, ranks compared as they are; the best fifty."""
    return search.search(stored(spark, d), "kiln", limit=50).select("folder", "rel_path", F.round("rank", 6).alias("rank"))


# -- orders and limits -------------------------------------------------------------------
PAGE = 200


@query(f"SELECT query_id, file_mtime FROM (SELECT id AS query_id, coalesce(file_mtime, 0) AS file_mtime FROM q ORDER BY q.file_mtime DESC NULLS LAST, title, id LIMIT {PAGE})")
def o1_default_order(spark: SparkSession, d: str) -> DataFrame:
    """O1: the first page of the empty search, newest first."""
    return search.search(stored(spark, d), "", limit=PAGE).select("query_id", "file_mtime")


_ORDERS = {"name_asc": "lower(title)", "name_desc": "lower(title) DESC", "mtime_desc": "coalesce(file_mtime, 0) DESC", "mtime_asc": "coalesce(file_mtime, 0)"}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS mode, id AS query_id, title FROM q ORDER BY {o}, id LIMIT {PAGE})" for k, o in _ORDERS.items()))
def o4_sort_modes(spark: SparkSession, d: str) -> DataFrame:
    """The first page of a result list in each of its four orders; a limited order is merged from the best rows of each task."""
    q = cat.queries(spark, d).select(F.col("id").alias("query_id"), "title", F.coalesce("file_mtime", F.lit(0)).alias("file_mtime"))
    pages = [search.sorted_results(q, k).limit(PAGE).select(F.lit(k).alias("mode"), "query_id", "title") for k in search.SORTS]
    return reduce(DataFrame.unionByName, pages)


@query("SELECT project, rel_path, viewed_at FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY viewed_at DESC, rel_path) AS r FROM (SELECT project, rel_path, max(viewed_at) AS viewed_at FROM views WHERE viewed_at IS NOT NULL GROUP BY ALL)) WHERE r <= 20")
def o5_recent_per_project(spark: SparkSession, d: str) -> DataFrame:
    """The twenty files of each project that were viewed last."""
    return coll.top_recent(coll.last_views(cat.views(spark, d), ["project", "rel_path"]), "project")


@query("SELECT project, last_view FROM (SELECT project, max(viewed_at) AS last_view FROM views WHERE viewed_at IS NOT NULL GROUP BY project ORDER BY last_view DESC, project LIMIT 10)")
def o7_recent_projects(spark: SparkSession, d: str) -> DataFrame:
    """The ten projects that were opened last."""
    return coll.recent_projects(cat.views(spark, d))


@query("SELECT DISTINCT tag FROM links")
def o8_tags_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Tags of all projects in order."""
    return coll.all_tags(cat.links(spark, d))


@query("SELECT query_id, array_to_string((list(tag ORDER BY tag))[1:2], ' ') AS chips FROM links GROUP BY query_id")
def o9_tag_chips(spark: SparkSession, d: str) -> DataFrame:
    return search.tags_of(cat.links(spark, d)).select("query_id", F.array_join(fx.chips(F.col("tags")), " ").alias("chips"))


# -- collections and statistics ------------------------------------------------------------
@query("SELECT project, count(*) AS queries FROM q GROUP BY project")
def g1_count(spark: SparkSession, d: str) -> DataFrame:
    """Files per project."""
    return coll.file_counts(table(spark, d, "queries"))


@query(
    """SELECT a.project, a.queries, coalesce(t.n, 0) AS tags, coalesce(f.n, 0) AS favorites, coalesce(o.tables, 0) AS tables, coalesce(o.columns, 0) AS columns
FROM (SELECT project, count(*) AS queries FROM q GROUP BY project) a
LEFT JOIN (SELECT project, count(DISTINCT tag) AS n FROM links JOIN q ON q.id = query_id GROUP BY project) t USING (project)
LEFT JOIN (SELECT project, count(*) AS n FROM favs GROUP BY project) f USING (project)
LEFT JOIN (SELECT project, count(DISTINCT object_key) FILTER (object_type = 'table') AS tables, count(DISTINCT object_key) FILTER (object_type = 'column') AS columns FROM objs JOIN q ON q.id = query_id GROUP BY project) o USING (project)"""
)
def g2_project_stats(spark: SparkSession, d: str) -> DataFrame:
    q = cat.queries(spark, d)
    return coll.project_stats(q, cat.with_project(spark, d, cat.links(spark, d)), cat.with_project(spark, d, cat.objects(spark, d)), cat.favorites(spark, d))


@query(
    """, spelled AS (SELECT project, object_type, object_key, min(object_name) AS name FROM objs JOIN q ON q.id = query_id GROUP BY ALL)
SELECT 'queries' AS statistic, count(*) AS value FROM q UNION ALL SELECT 'folders', count(DISTINCT project) FROM q UNION ALL SELECT 'tags', count(DISTINCT tag) FROM links JOIN q ON q.id = query_id
UNION ALL SELECT 'favorites', count(*) FROM favs UNION ALL SELECT 'tables', count(DISTINCT name) FROM spelled WHERE object_type = 'table' UNION ALL SELECT 'columns', count(DISTINCT name) FROM spelled WHERE object_type = 'column'"""
)
def g3_global_stats(spark: SparkSession, d: str) -> DataFrame:
    q = cat.queries(spark, d)
    return coll.global_stats(q, cat.with_project(spark, d, cat.links(spark, d)), cat.with_project(spark, d, cat.objects(spark, d)), cat.favorites(spark, d))


@query("SELECT q.id, q.project, q.rel_path, q.title FROM q JOIN favs USING (project, rel_path)")
def c1_favorites(spark: SparkSession, d: str) -> DataFrame:
    """Favorites of all projects; lost paths drop out."""
    return coll.favorites(cat.queries(spark, d), cat.favorites(spark, d)).select("id", "project", "rel_path", "title")


@query("SELECT id, project, rel_path, viewed_at FROM (SELECT q.id, q.project, q.rel_path, v.viewed_at FROM q JOIN (SELECT project, rel_path, max(viewed_at) AS viewed_at FROM views WHERE viewed_at IS NOT NULL GROUP BY ALL) v USING (project, rel_path) ORDER BY v.viewed_at DESC, project, rel_path LIMIT 20)")
def c2_recently_viewed(spark: SparkSession, d: str) -> DataFrame:
    """The twenty files viewed last."""
    last = coll.last_views(cat.views(spark, d), ["project", "rel_path"])
    return coll.recent(cat.queries(spark, d).select("id", "project", "rel_path"), last).select("id", "project", "rel_path", "viewed_at")


@query("SELECT user_id, props, count(*) % 2 = 1 AS is_favorite FROM events WHERE event_type = 'click' GROUP BY ALL")
def c3_toggled(spark: SparkSession, d: str) -> DataFrame:
    """State after a log of toggles."""
    return coll.toggled(table(spark, d, "events").where("event_type = 'click'"), ["user_id", "props"])


@query(
    """, recent AS (SELECT DISTINCT project, rel_path FROM recently_viewed)
SELECT project, rel_path FROM favs WHERE (project, rel_path) NOT IN (SELECT (project, rel_path) FROM recent) UNION ALL SELECT project, rel_path FROM recent WHERE (project, rel_path) NOT IN (SELECT (project, rel_path) FROM favs)"""
)
def c3_toggle_batch(spark: SparkSession, d: str) -> DataFrame:
    """Favorites after every viewed file was toggled."""
    return coll.toggle(cat.favorites(spark, d), table(spark, d, "recently_viewed").select("project", "rel_path"))


@query("SELECT project, rel_path, max(viewed_at) AS viewed_at, count(*) AS views FROM (SELECT DISTINCT * FROM views WHERE viewed_at IS NOT NULL) GROUP BY ALL")
def c5_record_views(spark: SparkSession, d: str) -> DataFrame:
    """Latest view of each file, with the number of different views."""
    return cat.views(spark, d).distinct().groupBy("project", "rel_path").agg(F.max("viewed_at").alias("viewed_at"), F.count("*").alias("views"))


# -- scalar functions ---------------------------------------------------------------------
_TPL = "'{{{{name}}}} ' || coalesce(text, '') || ' {{{{lang}}}} {{{{name}}}} {{{{none}}}}'".replace("{{{{", "{{").replace("}}}}", "}}")


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\{\{([\p{L}\p{N}_]+)\}\}', 1))), ' ') AS params FROM documents WHERE text IS NOT NULL")
def u1_template_params(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.array_sort(fx.template_params(F.col("text"))), " ").alias("params"))


_FILLED = r"regexp_replace(regexp_replace(body, '\{\{name\}\}', 'N-' || doc_id, 'g'), '\{\{lang\}\}', 'L', 'g')"


@query("SELECT doc_id, md5(" + _FILLED + ") AS filled FROM (SELECT doc_id, '{{name}} ' || coalesce(text, '') || ' {{lang}} {{name}} {{none}} {{ name }} {lang}' AS body FROM documents)")
def u2_apply_template(spark: SparkSession, d: str) -> DataFrame:
    """Known names are filled; other braces stay as they are."""
    body = F.concat(F.lit("{{name}} "), F.coalesce("text", F.lit("")), F.lit(" {{lang}} {{name}} {{none}} {{ name }} {lang}"))
    params = F.create_map(F.lit("name"), F.concat(F.lit("N-"), "doc_id"), F.lit("lang"), F.lit("L"))
    return table(spark, d, "documents").select("doc_id", F.md5(fx.apply_template(body, params)).alias("filled"))


_NAME = r"coalesce(nullif(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}-]', '', 'g'), '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}_]+', '_', 'g'), ''), 'query')".format(_STRIP.format("title"))


@query(f"SELECT id, {_NAME} AS stem FROM q")
def u3_safe_filename(spark: SparkSession, d: str) -> DataFrame:
    """The file stem of every title."""
    return cat.queries(spark, d).select("id", fx.safe_filename(F.col("title")).alias("stem"))


@query(
    rf""", stems AS (SELECT id, project, {_NAME} AS stem, row_number() OVER (PARTITION BY project, {_NAME} ORDER BY id) - 1 AS k FROM q),
held AS (SELECT DISTINCT project, regexp_extract(stem, '^(.+)_([1-9][0-9]{{0,8}})$', 1) AS stem, try_cast(regexp_extract(stem, '^(.+)_([1-9][0-9]{{0,8}})$', 2) AS BIGINT) AS k FROM stems),
most AS (SELECT s.project, s.stem, max(s.k) + (SELECT count(*) FROM held h WHERE h.project = s.project AND h.stem = s.stem) AS m FROM stems s GROUP BY s.project, s.stem),
free AS (SELECT project, stem, n, row_number() OVER (PARTITION BY project, stem ORDER BY n) AS k FROM (SELECT project, stem, unnest(range(1, m + 1)) AS n FROM most) x WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.project = x.project AND h.stem = x.stem AND h.k = x.n))
SELECT s.id, s.stem || CASE WHEN s.k = 0 THEN '' ELSE '_' || f.n END || '.sql' AS file_name FROM stems s LEFT JOIN free f ON f.project = s.project AND f.stem = s.stem AND f.k = s.k"""
)
def u4_unique_names(spark: SparkSession, d: str) -> DataFrame:
    """U4: a free file name for every title, over all titles of a project."""
    q = cat.queries(spark, d).select("id", "project", fx.safe_filename(F.col("title")).alias("stem"))
    return coll.unique_names(q, "stem", "id").select("id", "file_name")


_AGO = f"date_diff('day', try_strptime(updated_at[1:10], '%Y-%m-%d')::DATE, DATE '{TODAY}')"
_LABEL = f"CASE WHEN {_AGO} IS NULL THEN '' WHEN {_AGO} = 0 THEN 'today' WHEN {_AGO} = 1 THEN 'yesterday' WHEN {_AGO} < 7 THEN {_AGO} || 'd' WHEN {_AGO} < 30 THEN ({_AGO} // 7) || 'w' WHEN {_AGO} < 365 THEN ({_AGO} // 30) || 'mo' ELSE ({_AGO} // 365) || 'y' END"


@query(f"SELECT id, {_LABEL} AS label FROM q")
def u5_relative_date(spark: SparkSession, d: str) -> DataFrame:
    return cat.queries(spark, d).select("id", fx.relative_date(F.col("updated_at"), F.lit(TODAY).cast("date")).alias("label"))


@query(f"SELECT q.id, coalesce(o.t, {_LABEL}) AS label FROM q LEFT JOIN (SELECT query_id, min(object_name) AS t FROM objs WHERE object_type = 'table' GROUP BY query_id) o ON o.query_id = q.id")
def u6_meta_label(spark: SparkSession, d: str) -> DataFrame:
    names = cat.objects(spark, d).where("object_type = 'table'").groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list("object_name")).alias("tables"))
    return cat.queries(spark, d).select("id", "updated_at").join(names, "id", "left").select("id", fx.meta_label(F.col("tables"), F.col("updated_at"), F.lit(TODAY).cast("date")).alias("label"))


@query("SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(replace('#' || name || ', a,#B b ' || name, ',', ' '), '\\s+'), lambda t: lower(trim(t, '#'))), lambda t: t <> ''))), ' ') AS tags FROM tags")
def u7_input_tags(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("#"), "name", F.lit(", a,#B b "), "name")
    return table(spark, d, "tags").select("id", F.array_join(F.array_sort(fx.input_tags(raw)), " ").alias("tags"))


@query("SELECT id, array_to_string(list_filter(list_transform(string_split(name || ', X ,,' || name, ','), lambda t: lower(trim(t))), lambda t: t <> ''), ',') AS tags FROM tags")
def u8_template_tags(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("name", F.lit(", X ,,"), "name")
    return table(spark, d, "tags").select("id", F.array_join(fx.template_tags(raw), ",").alias("tags"))


@query("SELECT DISTINCT tag FROM links WHERE contains(tag, 're') AND tag NOT IN (SELECT tag FROM links WHERE query_id % 50 = 0)")
def u9_tag_suggestions(spark: SparkSession, d: str) -> DataFrame:
    links = cat.links(spark, d)
    return coll.suggestions(links.select("tag").distinct(), links.where("query_id % 50 = 0").select("tag").distinct(), "RE")


@query(r"SELECT id, len(regexp_extract_all(body, '(?i)\btenant_id\b')) AS occurrences FROM q")
def u10_word_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return cat.queries(spark, d).select("id", fx.word_occurrences(F.col("body"), "tenant_id").alias("occurrences"))


_NOTED = r"regexp_replace(body, '(?s)/\*.*?(?:\*/|\z)', ' ', 'g')"
_BARE = rf"regexp_replace({_NOTED}, '--[^\n]*', ' ', 'g')"
_UNQ = rf"regexp_replace({_BARE}, '''[^''\n]*''', ' ', 'g')"


@query(
    rf"""SELECT id, len(regexp_extract_all({_UNQ}, '(?i)\b(?:{"|".join(fx.KEYWORDS)})\b')) AS keywords, len(regexp_extract_all({_BARE}, '''[^''\n]*''')) AS strings,
len(regexp_extract_all({_UNQ}, '\b\d+\b')) AS numbers, len(regexp_extract_all(body, '(?s)/\*.*?(?:\*/|\z)')) + len(regexp_extract_all({_NOTED}, '--[^\n]*')) AS comments FROM q"""
)
def u11_lexical_counts(spark: SparkSession, d: str) -> DataFrame:
    return cat.queries(spark, d).select("id", *[c.alias(k) for k, c in fx.lexical_counts(F.col("body")).items()])


@query(f"SELECT * FROM ({_RESULT}) WHERE (contains(lower(title), 'kiln') OR contains(lower(rel_path), 'kiln') OR contains(tags, 'kiln')) AND query_id IN (SELECT query_id FROM objs WHERE object_type = 'table' AND lower(object_name) = 'kiln')")
def u12_palette(spark: SparkSession, d: str) -> DataFrame:
    """The second search over results at hand; col: has no effect."""
    return _flat(search.palette(search.search(cat.catalog(spark, d), ""), "table:Kiln col:nothing Kiln"))


@query("SELECT id, 'table:' || object_name AS search_text FROM q JOIN objs ON query_id = id WHERE object_type = 'table'")
def u13_reverse_search(spark: SparkSession, d: str) -> DataFrame:
    names = cat.objects(spark, d).where("object_type = 'table'").join(cat.queries(spark, d).select(F.col("id").alias("query_id")), "query_id", "left_semi")
    return names.select(F.col("query_id").alias("id"), F.concat(F.lit(search.chip_search("table", "")), "object_name").alias("search_text"))


@query(
    """SELECT id, version, newer FROM (SELECT id, v AS version, CASE WHEN list_bool_and(list_transform(string_split(ltrim(v, 'v'), '.'), lambda x: try_cast(x AS INTEGER) IS NOT NULL))
THEN list_transform(string_split(ltrim(v, 'v'), '.'), lambda x: try_cast(x AS INTEGER)) ELSE [0] END > [1, 9, 0] AS newer
FROM (SELECT id, 'v' || (id % 3) || '.' || (id % 12) || CASE WHEN id % 7 = 0 THEN '.x' ELSE '' END AS v FROM q))"""
)
def u14_newer_version(spark: SparkSession, d: str) -> DataFrame:
    v = F.concat(F.lit("v"), F.expr("id % 3"), F.lit("."), F.expr("id % 12"), F.when(F.expr("id % 7 = 0"), ".x").otherwise(""))
    return table(spark, d, "queries").select("id").distinct().select("id", v.alias("version"), (fx.version_key(v) > F.array(F.lit(1), F.lit(9), F.lit(0))).alias("newer"))


@query("SELECT id, CASE dialect WHEN 'tsql' THEN 'Server' WHEN 'sqlite' THEN 'Datei' ELSE dialect END AS label FROM q")
def u15_translated(spark: SparkSession, d: str) -> DataFrame:
    """Active language, else English, else the key."""
    label = fx.translated(F.col("dialect"), {"sqlite": "Datei"}, {"sqlite": "File", "tsql": "Server"})
    return table(spark, d, "queries").select("id", "dialect").distinct().select("id", label.alias("label"))


@query("SELECT project, CAST(floor(100 * count(description) / count(*)) AS BIGINT) AS described FROM q GROUP BY project")
def u16_percent(spark: SparkSession, d: str) -> DataFrame:
    """U16: share of described files in whole percent."""
    q = table(spark, d, "queries").select("id", "project", "description").distinct()
    return q.groupBy("project").agg(F.count("description").alias("n"), F.count("*").alias("total")).select("project", fx.percent(F.col("n"), F.col("total")).alias("described"))


@query("SELECT count(*) AS total FROM q")
def g4_total(spark: SparkSession, d: str) -> DataFrame:
    """Files over all projects."""
    return coll.file_total(table(spark, d, "queries"))


@query("SELECT project, rel_path, title, viewed_at FROM (SELECT q.project, q.rel_path, q.title, v.viewed_at, row_number() OVER (PARTITION BY q.project ORDER BY v.viewed_at DESC, q.rel_path) AS r FROM q JOIN (SELECT project, rel_path, max(viewed_at) AS viewed_at FROM views WHERE viewed_at IS NOT NULL GROUP BY ALL) v ON v.project = q.project AND v.rel_path = q.rel_path) WHERE r <= 10")
def c8_recent_by_project(spark: SparkSession, d: str) -> DataFrame:
    """The ten files of each project that still exist and were viewed last."""
    last = coll.last_views(cat.views(spark, d), ["project", "rel_path"])
    there = cat.queries(spark, d).select("project", "rel_path", "title").join(last, ["project", "rel_path"])
    return coll.top_recent(there, "project", n=10)


@query("SELECT project, tag, count(DISTINCT query_id) AS queries FROM links JOIN q ON q.id = query_id GROUP BY ALL")
def c9_tags_by_project(spark: SparkSession, d: str) -> DataFrame:
    """Tags of each project with the number of their files."""
    return coll.tags_by_project(cat.with_project(spark, d, cat.links(spark, d)))


# -- watching ------------------------------------------------------------------------------
_EVENTS = """, e AS (
SELECT 'u' || user_id AS project, props || '.sql' AS path, CASE WHEN event_type IN ('error', 'signup') THEN 'delete' ELSE 'modify' END AS op, ts FROM events
UNION ALL SELECT 'u' || user_id, 'moved ' || props || '.sql', 'modify', ts FROM events WHERE event_type = 'signup')"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "moved").otherwise("modified")
    e = table(spark, d, "events").select(
        F.concat(F.lit("u"), "user_id").alias("project"),
        F.concat("props", F.lit(".sql")).alias("path"),
        kind.alias("op"),
        F.when(kind == "moved", F.concat(F.lit("moved "), "props", F.lit(".sql"))).alias("dest"),
        F.lit(False).alias("is_directory"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    return watch.changes(e)


@query(_EVENTS + " SELECT project, path, op, ts FROM e")
def w1_changes(spark: SparkSession, d: str) -> DataFrame:
    """Change events of SQL files; a move gives two."""
    return _events(spark, d).select("project", "path", "op", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(
    _EVENTS
    + """, marked AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY project ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS cut FROM e),
numbered AS (SELECT *, sum(cut) OVER (PARTITION BY project ORDER BY ts) AS island FROM marked),
lasts AS (SELECT project, island, path, arg_max(op, (ts, op)) AS op FROM numbered GROUP BY ALL),
spans AS (SELECT project, island, min(ts) AS start FROM numbered GROUP BY ALL)
SELECT s.project, s.start, string_agg(path, ' ' ORDER BY path) FILTER (op = 'modify') AS modified, string_agg(path, ' ' ORDER BY path) FILTER (op = 'delete') AS deleted FROM lasts l JOIN spans s USING (project, island) GROUP BY ALL"""
)
def w3_batches(spark: SparkSession, d: str) -> DataFrame:
    """Debounced batches, with a gap of two hours for this sparse log."""
    b = watch.batches(_events(spark, d), "2 hours")
    join = lambda c: F.nullif(F.array_join(c, " "), F.lit(""))
    return b.select("project", F.col("start").cast("timestamp_ntz").alias("start"), join("modified").alias("modified"), join("deleted").alias("deleted"))


