"""Line dedup by a log-template tree, in DataFrame functions only.

Lines run down a tree of fixed depth: by their number of tokens, then by their first
``depth`` tokens, where a token with a digit counts as a variable field.  In a leaf
the other fields are generalised at several levels: at level k a token stays in the
template only where at least ``min_docs`` * 2**k different texts of the leaf have it in
that place; any other place is variable.  So a field of common words becomes variable
at some level however large the leaf is, and a rare template beside a frequent one
still has its own level.  Where a line's constant tokens make up less than
``similarity`` of its tokens without a digit, that level gives it no template.  A
template found in at least ``min_docs`` different texts is recurring.  A long line, of
more than ``long_tokens`` tokens, has its own words as one more template, without any
field, and that recurs from two different texts on.  Lines of a recurring template are
dropped everywhere but in the text whose document has the smallest id, so that no
wording leaves the corpus altogether.

Different texts are counted, not rows, and all copies of a text are treated alike: they
don't make their own lines recur and stay copies of one another.  Only leaves with enough
different texts go on, so all later steps see a small share of the lines; lines of fewer
than ``min_tokens`` tokens have no template and stay, however often they occur.  Every
count is a partial aggregate; texts move only if the dropped line numbers are too many to
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.tables import read, without
from heliograph.storage import Scratch, join_checked

FIELD = "<*>"
GAPS = r"[ \t\x0B\f\r]+"


def tokens_of(line: Column) -> Column:
    """Tokens of a line (split at spaces, tabs, form feeds and carriage returns), variable fields generalised.

    Most lines have no digit and no gap but spaces; those take the short way, without a
    regular expression for each token.
    """
    plain = F.array_remove(F.split(line, " "), "")
    words = F.array_remove(F.split(line, GAPS), "")
    masked = F.transform(words, lambda x: F.when(x.rlike("[0-9]"), F.lit(FIELD)).otherwise(x))
    return F.when(line.rlike(r"[0-9\t\x0B\f\r]"), masked).otherwise(plain)


#: A text is known by two independent hashes, 96 bits, so that no two texts are taken for one.
KNOWN = ("h", "g")


def known(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("h"), F.hash(F.lit("text"), text).alias("g")]


def dropped_lines(
    docs: DataFrame, *, min_docs: int = 20, depth: int = 3, min_tokens: int = 3, similarity: float = 0.8, long_tokens: int = 50, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(h, g, drops): by a text's two hashes, the numbers (from 0) of the lines to drop."""
    scratch = Scratch(docs.sparkSession, "lines")
    # hashed before the lines part, or every line would carry its whole text along to be hashed
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), *known(text), F.split(text, "\n", -1).alias("ls"))
    rows = rows.select("d", *KNOWN, F.posexplode("ls").alias("no", "line"))
    # as a generated column, for a filter on an expression would have it worked out twice
    lines = rows.select("*", F.explode(F.array(tokens_of(F.col("line")))).alias("t")).where(F.size("t") >= min_tokens)
    lines = lines.withColumn("node", F.xxhash64(F.size("t"), F.slice("t", 1, depth)))
    words = F.xxhash64(F.lit("words"), F.array_remove(F.split("line", GAPS), ""))
    index = scratch.table(lines.select("d", *KNOWN, "no", "node", F.when(F.size("t") > long_tokens, words).alias("words")), "index")
    nodes = index.select("node", *KNOWN).distinct().groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("node")
    nodes = scratch.table(nodes, "nodes")
    held = join_checked(lines.select("d", *KNOWN, "no", "node", "t"), nodes, "node", "left_semi")
    held = scratch.table(held.groupBy(*KNOWN, "no").agg(F.min("d").alias("d"), F.first("node").alias("node"), F.first("t").alias("t")), "held")

    plain = F.size(F.filter("t", lambda x: x != FIELD)).alias("plain")
    fields = held.select("d", *KNOWN, "no", "node", plain, F.posexplode("t").alias("place", "token")).where(F.col("token") != FIELD)
    often = fields.groupBy("node", "place", "token").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).drop("n")
    often = scratch.table(often, "often")
    # only tokens of enough lines are counted again, by different texts
    texts = join_checked(fields.select("node", "place", "token", *KNOWN), often, ["node", "place", "token"], "left_semi").distinct()
    texts = texts.groupBy("node", "place", "token").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    constant = scratch.table(texts.withColumn("level", F.floor(F.log2(F.col("n") / min_docs)).cast("int")).drop("n"), "constant")
    kept = join_checked(fields, constant, ["node", "place", "token"])
    levels = kept.groupBy("d", *KNOWN, "no", "node", "plain", "level").agg(F.count("*").alias("fixed"), F.bit_xor(F.xxhash64("place", "token")).alias("mark"))
    levels = levels.groupBy("d", *KNOWN, "no", "node", "plain").agg(F.collect_list(F.struct("level", "fixed", "mark")).alias("ls"))
    from_level = lambda x: F.filter("ls", lambda y: y["level"] >= x["level"])
    fixed = lambda x: F.aggregate(from_level(x), F.lit(0).cast("long"), lambda n, y: n + y["fixed"])
    mark = lambda x: F.aggregate(from_level(x), F.lit(0).cast("long"), lambda n, y: n.bitwiseXOR(y["mark"]))
    shapes = levels.select("d", *KNOWN, "no", "node", "plain", F.explode(F.transform("ls", lambda x: F.struct(fixed(x).alias("fixed"), mark(x).alias("mark")))).alias("x"))
    shaped = shapes.where(F.col("x.fixed") >= F.col("plain") * similarity)
    shaped = shaped.select("d", *KNOWN, "no", F.xxhash64("node", "x.fixed", "x.mark").alias("template"))
    same_words = index.where("words is not null").select("d", *KNOWN, "no", F.col("words").alias("template"), F.lit(2).alias("least"))
    shaped = scratch.table(shaped.withColumn("least", F.lit(min_docs)).unionByName(same_words), "shaped")

    texts = shaped.groupBy("template", "least", *KNOWN).agg(F.min(F.struct(F.col("d").isNull().alias("none"), "d")).alias("d"))
    recurring = texts.groupBy("template", "least").agg(F.count("*").alias("n"), F.min(F.struct("d", *KNOWN)).alias("first")).where("n >= least").select("template", F.col("first.h").alias("h1"), F.col("first.g").alias("g1"))
    recurring = scratch.table(recurring, "recurring")
    gone = join_checked(shaped, recurring, "template").where("h <> h1 or g <> g1")
    return scratch.table(gone.groupBy(*KNOWN).agg(F.array_sort(F.collect_set("no")).alias("drops")), "drops")


def drop_templates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with recurring lines taken out of the text, plus n_lines and n_dropped (long).

    Null texts stay null with 0 lines; an empty text has one line.  Documents that lose
    all lines keep their row with an empty text.  Repeated rows are treated alike; input
    columns named like the outputs are replaced.  A document with many lines is split
    and joined in its own row, never across rows.
    """
    base = without(docs, "n_lines", "n_dropped", "__h", "__g", "__ls", "__drops")
    drops = dropped_lines(base, text=text, doc_id=doc_id, **options).select(F.col("h").alias("__hd"), F.col("g").alias("__gd"), F.col("drops").alias("__drops"))
    keyed = base.select("*", *(c.alias(f"__{n}") for n, c in zip(KNOWN, known(text), strict=True)))
    joined = join_checked(keyed, drops, (F.col("__h") == F.col("__hd")) & (F.col("__g") == F.col("__gd")), "left")
    joined = joined.withColumn("__ls", F.split(text, "\n", -1))  # once, not for each line that is kept
    lines = F.col("__ls")
    n = F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0))
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__drops")
    clean = F.when(F.col("__drops").isNull(), F.col(text)).otherwise(F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumns({"n_lines": n.cast("long"), "n_dropped": F.coalesce(F.size("__drops"), F.lit(0)).cast("long"), text: clean})
    out = out.withColumn("n_dropped", F.when(F.col("__drops").isNull(), 0).otherwise(F.col("n_dropped")).cast("long"))
    return out.select(*[f"`{c}`" for c in base.columns], "n_lines", "n_dropped")


def op7_line_templates(spark, sf_dir):
    """Every document's lines, how many of them repeat a template of the corpus, and a digest of what stays."""
    cleaned = drop_templates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("clean_sha256"))


SQL = r"""
WITH rows AS (SELECT doc_id AS d, text AS h, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT min(d) AS d, h, no, line FROM (SELECT d, h, unnest(range(len(ls))) AS no, unnest(ls) AS line FROM rows) GROUP BY h, no, line),
split AS (SELECT d, h, no, list_filter(string_split_regex(line, '[ \t\x0B\f\r]+'), lambda x: x <> '') AS ws FROM lines),
masked AS (SELECT *, list_transform(ws, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM split),
placed AS (SELECT *, len(t) || chr(10) || array_to_string(t[1:3], ' ') AS node FROM masked WHERE len(t) >= 3),
nodes AS (SELECT node FROM placed GROUP BY node HAVING count(DISTINCT h) >= 20),
held AS (SELECT * FROM placed WHERE node IN (SELECT node FROM nodes)),
fields AS (SELECT * FROM (SELECT d, h, no, node, unnest(range(len(t))) AS place, unnest(t) AS token FROM held) WHERE token <> '<*>'),
constant AS (SELECT node, place, token FROM fields GROUP BY ALL HAVING count(DISTINCT h) >= 20),
marks AS (SELECT d, h, no, node, count(*) AS fixed, string_agg(place || ' ' || token, chr(10) ORDER BY place) AS mark
          FROM fields JOIN constant USING (node, place, token) GROUP BY ALL),
shaped AS (SELECT m.d, m.h, m.no, m.node || chr(10) || m.mark AS template, 20 AS least FROM marks m JOIN held USING (h, no)
           WHERE m.fixed >= len(list_filter(t, lambda x: x <> '<*>')) * 0.8::DOUBLE
           UNION ALL SELECT d, h, no, 'words' || chr(10) || array_to_string(ws, ' '), 2 FROM placed WHERE len(ws) > 50),
recurring AS (SELECT template, arg_min(h, d) AS first FROM shaped GROUP BY template, least HAVING count(DISTINCT h) >= least),
drops AS (SELECT h, list(DISTINCT no) AS gone FROM shaped JOIN recurring USING (template) WHERE h <> first GROUP BY h),
kept AS (SELECT r.doc_id, r.text, string_split(r.text, chr(10)) AS ls, coalesce(x.gone, []) AS gone
         FROM documents r LEFT JOIN drops x ON x.h = r.text)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_dropped,
       sha256(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i - 1)), chr(10))) AS clean_sha256
FROM kept
"""
