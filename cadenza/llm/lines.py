"""Line dedup by a log-template tree: leaves by token count and leading tokens, templates with variable
fields, recurring templates dropped. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import WORD, bound, table, written

#: Leading tokens that make a path of the tree, after the token count.
DEPTH = 3
#: A template recurs if it is in this many documents. A token is constant at its place in a leaf if the leaf's lines have
#: it there in this many.
MIN_DOCS = 3
#: From this many tokens on a passage, be it one line or neighbouring ones, recurs if it is in two documents.
PASSAGE_TOKENS, PASSAGE_DOCS = 50, 2
#: A line is generalised if this share of its tokens after the leading ones (fields apart) is constant.
AGREE = 0.5
FIELD = "<*>"


def masked(line: Column) -> Column:
    """The line with every token that holds a digit as a variable field, white space made single spaces."""
    odd = F.regexp_like(line, F.lit(r"[0-9\t\x0B\f\r]")) | F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(
        odd,
        F.trim(F.regexp_replace(F.regexp_replace(line, r"[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*", FIELD), r"[\x20\x09-\x0D]+", " ")),
    ).otherwise(line)


def lines(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, h, pos, place, n, leaf, exact, line) of every line that isn't blank; h hashes the document's text.

    `line` is masked; a line no longer than a path keeps its numbers, so it recurs only as it stands. `leaf` names the
    path in the tree, `exact` the line, `place` counts the lines that aren't blank.
    """
    # single spaces part the tokens of a masked line; a bound variable, as a plain column would be computed at each use
    tokens = lambda m: F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1
    plain = lambda raw: F.trim(F.regexp_replace(raw, r"[\x20\x09-\x0D]+", " "))
    line = lambda raw: bound(masked(raw), lambda m: F.when(tokens(m) < depth, plain(raw)).otherwise(m))
    each = F.transform(F.split("text", "\n", -1), lambda raw, i: bound(line(raw), lambda m: F.struct(i.alias("pos"), tokens(m).alias("n"), m.alias("line"))))
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")  # h isn't made again for each line
    rows = rows.select("doc_id", "h", F.posexplode(F.filter(each, lambda x: x["line"] != "")).alias("place", "x")).select("doc_id", "h", "place", "x.*")
    head = F.substring_index("line", " ", depth)
    return rows.select("doc_id", "h", "pos", "place", "n", F.xxhash64("n", head).alias("leaf"), F.xxhash64("line").alias("exact"), "line")


def generalised(docs: DataFrame, per_line: DataFrame, least_docs: int = MIN_DOCS, depth: int = DEPTH) -> DataFrame:
    """(leaf, exact, template) of the lines whose template isn't themselves.

    In leaves in which different lines meet, the documents of the lines that have a token at a place are added up; rare
    tokens are variable fields. So a leaf has as many templates as there are ways in which its frequent tokens go
    together. A line of which too few tokens are constant stays a template of its own.
    """
    mixed = per_line.where(F.col("n") > depth).groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("docs").alias("docs"))
    mixed = written(mixed.where((F.col("kinds") > 1) & (F.col("docs") >= least_docs)).select("leaf"), "leaves")
    # plain joins: Spark broadcasts a side only if its files are below its threshold
    some = lines(docs, depth).where(F.col("n") > depth).select("leaf", "exact", "line").join(mixed, "leaf")
    some = some.groupBy("leaf", "exact").agg(F.min("line").alias("line"))
    some = written(some.join(per_line.select("leaf", "exact", "docs"), ["leaf", "exact"]), "leaf-lines")
    each = some.select("leaf", "exact", "docs", F.posexplode(F.split("line", " ", -1)).alias("at", "token")).where((F.col("at") >= depth) & (F.col("token") != FIELD))
    votes = written(each.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("votes")).where(F.col("votes") >= least_docs).drop("votes"), "constants")
    const = each.join(votes, ["leaf", "at", "token"]).groupBy("leaf", "exact").agg(F.collect_list("at").alias("const"))
    const = written(const, "line-constants")
    words = F.split("line", " ", -1)
    template = F.array_join(F.transform(words, lambda w, i: F.when((i < depth) | F.array_contains("const", i), w).otherwise(FIELD)), " ")
    variable = F.size(F.filter(F.slice(words, depth + 1, 1 << 30), lambda w: w != FIELD))
    out = some.join(const, ["leaf", "exact"]).where(F.size("const") >= AGREE * variable)
    return out.select("leaf", "exact", F.xxhash64(template).alias("template")).where("template <> exact")


def islands(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with `run`, the same number for those of a partition whose places follow each other without a gap."""
    return rows.withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy(*by).orderBy("place")))


def passages(at: DataFrame, shared: DataFrame, held: DataFrame, passage_docs: int = PASSAGE_DOCS) -> DataFrame:
    """(doc_id, h, pos): lines of a run of neighbouring lines that make PASSAGE_TOKENS together and stand in two documents.

    `shared` has (leaf, exact, template, docs, first) of the lines in two documents or more, `held` (leaf, template,
    doc) of these. A line that only two documents have names the other one in `other`; lines that more have count in
    a run if that document has them too. The first of the two documents keeps the run.
    """
    rows = at.join(shared.select("leaf", "exact", "template", "docs", "first"), ["leaf", "exact"]).withColumn("doc", document())
    rows = rows.withColumn("other", F.when((F.col("docs") == passage_docs) & (F.col("doc") != F.col("first")), F.col("first")))
    rows = rows.groupBy("doc", "place").agg(*[F.first(c).alias(c) for c in ("pos", "n", "leaf", "template", "other")])  # rows repeated in all are one document
    rows = written(rows, "shared-lines")
    some = written(rows.where("other is not null").select("doc").distinct(), "some")
    rows = islands(rows.join(some, "doc"), ["doc"])
    # the nearest document named before and after a line of the run
    for name, order in (("before", F.col("place")), ("after", F.col("place").desc())):
        rows = rows.withColumn(name, F.last("other", True).over(Window.partitionBy("doc", "run").orderBy(order)))
    near = F.when(F.col("other").isNotNull(), F.array("other")).otherwise(F.array_distinct(F.array_compact(F.array("before", "after"))))
    rows = rows.select("doc", "place", "pos", "n", "leaf", "template", F.col("other").isNotNull().alias("own"), F.explode(near).alias("other"))
    rows = written(rows, "neighbours")
    has = held.select("leaf", "template", F.col("doc").alias("other"))
    more = rows.where("not own").join(has, ["leaf", "template", "other"], "left_semi")
    rows = islands(rows.where("own").unionByName(more), ["doc", "other"])
    whole = F.sum("n").over(Window.partitionBy("doc", "other", "run"))
    return rows.withColumn("all", whole).where((F.col("all") >= PASSAGE_TOKENS) & F.col("own")).select("doc.doc_id", "doc.h", "pos")


def document() -> Column:
    """What orders and names a document: null doc_ids last, then the text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h")


def templates(docs: DataFrame, keys: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(leaf, exact, n, template, docs, first) of lines whose template is in two documents or more, and (leaf, template,
    doc) of these templates.

    Lines are counted before they are joined, so that a line of very many documents is one row; only lines that share
    a template with other lines have their documents told apart.
    """
    per_line = keys.groupBy("leaf", "exact", "n").agg(F.count("*").alias("docs"), F.min("doc").alias("first"))
    per_line = written(per_line, "line-counts")
    other = written(generalised(docs, per_line, least_docs), "generalised")
    # a template may also be a line as it stands
    own = other.select("leaf", F.col("template").alias("exact")).distinct().join(per_line.select("leaf", "exact"), ["leaf", "exact"], "left_semi")
    own = own.join(other.select("leaf", "exact"), ["leaf", "exact"], "left_anti").withColumn("template", F.col("exact"))
    mapped = written(other.unionByName(own), "mapped")
    meet = written(keys.join(mapped, ["leaf", "exact"]).select("leaf", "template", "doc").distinct(), "meet")
    counts = meet.groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.min("doc").alias("first")).where("docs > 1")
    several = mapped.join(per_line.select("leaf", "exact", "n"), ["leaf", "exact"]).join(counts, ["leaf", "template"])
    alone = per_line.where("docs > 1").join(mapped.select("leaf", "exact"), ["leaf", "exact"], "left_anti").withColumn("template", F.col("exact"))
    shared = written(alone.unionByName(several.select(*alone.columns)), "shared")
    held = keys.join(shared.select("leaf", "exact", "template"), ["leaf", "exact"]).select("leaf", "template", "doc")
    return shared, held


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, passage_docs: int = PASSAGE_DOCS) -> DataFrame:
    """(doc_id, h, pos): lines to drop, those of recurring templates and passages in all documents but the first."""
    at = written(lines(docs).drop("line"), "lines")
    keys = written(at.select("leaf", "exact", "n", document().alias("doc")).distinct(), "line-docs")
    shared, held = templates(docs, keys, min_docs)
    often = shared.where((F.col("docs") >= min_docs) | ((F.col("n") >= PASSAGE_TOKENS) & (F.col("docs") >= passage_docs)))
    often = written(often.select("leaf", "exact", "first"), "recurring")
    out = at.select("doc_id", "h", "pos", "leaf", "exact").join(often, ["leaf", "exact"])
    out = out.where(~document().eqNullSafe(F.col("first"))).select("doc_id", "h", "pos")
    return out.unionByName(passages(at, shared, written(held, "held"), passage_docs))


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, passage_docs: int = PASSAGE_DOCS) -> DataFrame:
    """docs without the lines whose template recurs in `min_docs` documents (a passage of 50 tokens or more, in one
    line or in neighbouring ones: in `passage_docs`).

    The first document (by doc_id, nulls last, then text hash) keeps its lines, so nothing vanishes from the
    corpus; in it, and where nothing recurs, texts are unchanged to the byte. Null and empty texts stay; a text
    whose lines all go is empty; rows repeated in all of doc_id and text are one document. n_chars, if there,
    follows the text. Extra columns stay whatever their names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    gone = recurring(base, min_docs, passage_docs).groupBy("doc_id", "h").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "h").alias("key"), "gone")
    out = docs.select(row.alias("row")).withColumn("key", F.xxhash64(F.col("row.doc_id").isNull(), F.col("row.doc_id").cast("bigint"), F.xxhash64(F.col("row.text").cast("string"))))
    out = out.join(gone, "key", "left")
    rest = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(rest)
    out = out.select("row", text.alias("__text"))
    new = {"text": F.col("__text"), "n_chars": F.length("__text").cast("bigint")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_lines(docs)
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return out.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"), words.alias("n_words"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


#: In DuckDB: leaves and lines go by their texts, where the operator goes by hashes of them.
DROP_SQL = r"""
l0 AS (
  SELECT doc_id, md5(text) AS h, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS raw
  FROM (SELECT DISTINCT doc_id, text FROM {docs}) WHERE text IS NOT NULL),
l1 AS (
  SELECT *, trim(regexp_replace(raw, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS plain,
         CASE WHEN regexp_matches(raw, '[0-9\t\x0B\f\r]|  |^ | $')
              THEN trim(regexp_replace(regexp_replace(raw, '[^ \t\n\x0B\f\r0-9]*[0-9][^ \t\n\x0B\f\r]*', '<*>', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') ELSE raw END AS masked
  FROM l0),
l2 AS (
  SELECT doc_id, h, pos, CASE WHEN len(string_split(masked, ' ')) < 3 THEN plain ELSE masked END AS line FROM l1),
l3 AS (SELECT doc_id, h, pos, line, string_split(line, ' ') AS tokens FROM l2 WHERE line <> ''),
at_ AS (
  SELECT doc_id, h, pos, line, len(tokens) AS n, list_resize(tokens, least(3, len(tokens))) AS head, tokens,
         {{'null': doc_id IS NULL, 'id': doc_id, 'h': h}} AS doc,
         row_number() OVER (PARTITION BY doc_id, h ORDER BY pos) AS place
  FROM l3),
keys AS (SELECT DISTINCT n, head, line, doc FROM at_),
per_line AS (SELECT n, head, line, count(*) AS docs FROM keys GROUP BY ALL),
leaf AS (SELECT n, head FROM per_line WHERE n > 3 GROUP BY n, head HAVING count(*) > 1 AND sum(docs) >= 3),
each AS (
  SELECT n, head, line, docs, unnest(string_split(line, ' ')) AS token, generate_subscripts(string_split(line, ' '), 1) AS p
  FROM per_line JOIN leaf USING (n, head)),
votes AS (SELECT n, head, p, token, sum(docs) >= 3 AS constant FROM each WHERE p > 3 AND token <> '<*>' GROUP BY ALL),
toned AS (
  SELECT e.n, e.head, e.line, e.p, e.token, e.p <= 3 OR coalesce(v.constant, false) AS constant
  FROM each e LEFT JOIN votes v ON v.n = e.n AND v.head = e.head AND v.p = e.p AND v.token = e.token),
general AS (
  SELECT n, head, line, string_agg(CASE WHEN constant THEN token ELSE '<*>' END, ' ' ORDER BY p) AS template
  FROM toned GROUP BY n, head, line
  HAVING count(*) FILTER (p > 3 AND constant) >= 1
     AND count(*) FILTER (p > 3 AND constant) >= 0.5 * count(*) FILTER (p > 3 AND token <> '<*>')),
named AS (
  SELECT k.*, coalesce(g.template, k.line) AS template
  FROM keys k LEFT JOIN general g ON g.n = k.n AND g.head = k.head AND g.line = k.line),
held AS (SELECT DISTINCT n, head, template, doc FROM named),
per AS (SELECT n, head, template, count(*) AS docs, min(doc) AS first FROM held GROUP BY ALL HAVING count(*) >= 2),
seen AS (
  SELECT a.doc, a.doc_id, a.h, a.pos, a.place, a.n, a.head, m.template, p.docs, p.first
  FROM at_ a JOIN named m ON m.n = a.n AND m.head = a.head AND m.line = a.line AND m.doc = a.doc
  JOIN per p ON p.n = m.n AND p.head = m.head AND p.template = m.template),
own AS (SELECT *, CASE WHEN docs = 2 AND doc <> first THEN first END AS other FROM seen),
runs AS (
  SELECT *, place - row_number() OVER (PARTITION BY doc ORDER BY place) AS run FROM own
  WHERE doc IN (SELECT doc FROM own WHERE other IS NOT NULL)),
near AS (
  SELECT *, last_value(other IGNORE NULLS) OVER (PARTITION BY doc, run ORDER BY place ROWS UNBOUNDED PRECEDING) AS before,
         first_value(other IGNORE NULLS) OVER (PARTITION BY doc, run ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM runs),
pairs AS (
  SELECT doc, doc_id, h, pos, place, n, head, template, true AS own, other FROM near WHERE other IS NOT NULL
  UNION ALL
  SELECT e.doc, e.doc_id, e.h, e.pos, e.place, e.n, e.head, e.template, false, e.other
  FROM (SELECT DISTINCT * EXCLUDE (other, before, after), unnest([before, after]) AS other FROM near WHERE other IS NULL) e
  JOIN held x ON x.n = e.n AND x.head = e.head AND x.template = e.template AND x.doc = e.other),
parts AS (SELECT *, place - row_number() OVER (PARTITION BY doc, other ORDER BY place) AS part FROM pairs),
long AS (SELECT *, sum(n) OVER (PARTITION BY doc, other, part) AS all_ FROM parts),
gone AS (
  SELECT doc_id, h, list(DISTINCT pos) AS gone FROM (
    SELECT doc_id, h, pos FROM seen WHERE (docs >= 3 OR n >= 50) AND doc <> first
    UNION ALL SELECT doc_id, h, pos FROM long WHERE own AND all_ >= 50)
  GROUP BY doc_id, h),
deduped AS (
  SELECT d.* REPLACE (CASE WHEN g.gone IS NULL THEN d.text ELSE coalesce(array_to_string(
           list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(g.gone, i - 1)), chr(10)), '') END AS text)
  FROM {docs} d LEFT JOIN gone g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND md5(d.text) = g.h)
"""
OP8_SQL = (
    "WITH " + DROP_SQL.format(docs="documents") + r"""
SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars,
       CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) AS BIGINT) AS n_words, md5(coalesce(text, '')) AS text_md5
FROM deduped"""
)
