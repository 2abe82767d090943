"""Line dedup by content-defined chunks of lines, with built-in functions only.

A text is cut at line ends, and a hash over two neighbouring lines decides whether a chunk ends between them, in `FAMILIES`
independent ways at once: in family f a line opens a chunk or closes one by bit f of its own hash, and two lines stay
together where the first opens and the second closes. So a boundary depends on the two lines beside it alone: an inserted
or deleted line moves no other, and a passage is cut alike whatever stands around it. Chunks of two lines that occur again
anywhere are removed but for their first occurrence (smallest id, then place), after their bytes were compared with those
of the first one; what the families remove is united. Two neighbouring lines are a chunk in some family with probability
1 - (3/4) ** FAMILIES, and of three lines in a row two are with 1 - (1/2) ** FAMILIES. A line and its equal are never one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.common import bind, discard, stored

FAMILIES = 8  # up to 28, the bits of a line's hash


def line_hash(line: Column) -> Column:
    """28 bits of the line's md5, which SQL engines share."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("bigint")


def chunk_places(lines: Column, families: int = FAMILIES) -> Column:
    """Places of the lines that open a chunk of two in some family."""
    mask = (1 << families) - 1

    def places(h: Column) -> Column:
        opens = lambda i: F.get(h, i).bitwiseAND(F.bitwise_not(F.get(h, i + 1))).bitwiseAND(F.lit(mask)) != 0
        return F.when(F.size(h) > 1, F.filter(F.sequence(F.lit(0), F.size(h) - 2), opens)).otherwise(F.array().cast("array<int>"))

    return bind(F.transform(lines, line_hash), places)


def chunk_hashes(text: Column, families: int = FAMILIES) -> Column:
    """array<struct<pos, h>> of the text's chunks."""
    hashed = lambda lines: F.transform(chunk_places(lines, families), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.get(lines, i), F.get(lines, i + 1)).alias("h")))
    return bind(F.split(text, "\n", -1), hashed)


def dedup_lines(df: DataFrame, id_column: str = "doc_id", column: str = "text", families: int = FAMILIES) -> DataFrame:
    """`df` with `column` cut down, plus n_lines, n_removed_lines and n_removed_chunks.

    Null text stays null with 0 lines. Rows alike in id and text share their result and all keep a first occurrence;
    rows with a null id come last in the order and null ids are one id. Columns named like the three added give way.
    Every other column is kept, whatever its name. The one occurrence of a chunk that stays is the first of the smallest id;
    a line that goes with some chunk stays wherever the first one of these is. Empty tables give none, and texts of any
    length are read whole.
    """
    added = ["n_lines", "n_removed_lines", "n_removed_chunks"]
    kept = [c for c in df.columns if c not in added]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    # columns go by number inside, so that no name clashes
    own = {c: f"c{k}" for k, c in enumerate(kept)}
    base = df.select(F.struct(*[quoted(c).alias(n) for c, n in own.items()]).alias("_row"), quoted(id_column).alias("_id"), F.xxhash64(quoted(column)).alias("_text_hash"))
    text = F.coalesce(F.col("_row")[own[column]], F.lit(""))

    chunks = base.select("_id", "_text_hash", F.explode(chunk_hashes(text, families)).alias("chunk")).select("_id", "_text_hash", "chunk.pos", "chunk.h")
    repeated = chunks.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("owner")).where("n > 1").drop("n")
    # written, so that the join's sides are plain exchanges, and Spark can split a popular chunk's rows
    repeated = stored(repeated, "repeated-chunks")
    # few rows from here on: the occurrences of repeated chunks, by document; each step is written, so texts move twice only
    found = chunks.join(repeated, "h").select("_id", "_text_hash", "pos", "h", "owner")
    by_doc = stored(found.groupBy("_id", "_text_hash").agg(F.collect_list(F.struct("pos", "h", "owner")).alias("found")), "repeated")
    discard(repeated)

    same = lambda a, b: a["_id"].eqNullSafe(b["_id"]) & (a["_text_hash"] == b["_text_hash"])
    slim = base.select("_id", "_text_hash", text.alias("_text"))
    body = lambda lines, f: F.struct(f["pos"].alias("pos"), f["h"].alias("h"), f["owner"].alias("owner"), F.concat_ws("\n", F.get(lines, f["pos"]), F.get(lines, f["pos"] + 1)).alias("body"))
    texts = slim.join(by_doc.hint("merge"), same(slim, by_doc)).select(slim["_id"], slim["_text_hash"], "_text", "found")
    bodies = texts.select("_id", "_text_hash", F.explode(bind(F.split("_text", "\n", -1), lambda lines: F.transform("found", lambda f: body(lines, f)))).alias("f")).select("_id", "_text_hash", "f.*")
    bodies = stored(bodies, "bodies")
    discard(by_doc)
    # written, as the repeated chunks were
    owned = stored(bodies.where(F.col("_id").eqNullSafe(F.col("owner"))).groupBy("h").agg(F.min("body").alias("first_body")), "first-bodies")
    alike = bodies.join(owned, "h").where(F.col("body") == F.col("first_body"))
    # by document, not by chunk: copies of a popular chunk need not meet in one task
    each = alike.groupBy("_id", "_text_hash").agg(F.array_sort(F.collect_set(F.struct("h", "pos", "owner"))).alias("at"))

    def gone(at: Column) -> Column:
        """All places go, but the owner keeps a chunk's first; places of a chunk stand together, in order."""
        told = F.transform(at, lambda x, i: F.struct(x["pos"].alias("pos"), (x["owner"].eqNullSafe(F.col("_id")) & ((i == 0) | (F.get(at, i - 1)["h"] != x["h"]))).alias("first")))
        return F.transform(F.filter(told, lambda x: ~F.coalesce(x["first"], F.lit(True))), lambda x: x["pos"])

    removed = each.select("_id", "_text_hash", gone(F.col("at")).alias("gone")).where("size(gone) > 0")
    removed = stored(removed, "removed")
    discard(bodies)
    discard(owned)

    joined = base.join(removed.hint("merge"), same(base, removed), "left").select("_row", "gone")
    none = F.array().cast("array<int>")

    def decide(lines: Column) -> Column:
        lost = F.array_distinct(F.flatten(F.transform("gone", lambda i: F.array(i, i + 1))))
        return bind(lost, lambda lost: F.struct(
            F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost), lambda i: F.get(lines, i)), "\n").alias("text"),
            F.size(lost).alias("n_removed_lines"),
        ))

    whole = joined.select("_row", F.coalesce("gone", none).alias("gone"), F.when(F.col("gone").isNotNull(), bind(F.split(text, "\n", -1), decide)).alias("cut"))
    n_lines = F.when(F.col("_row")[own[column]].isNull(), 0).otherwise(F.length(text) - F.length(F.translate(text, "\n", "")) + 1)
    held = lambda c: F.col("_row")[own[c]]
    columns = [F.when(F.col("cut").isNotNull() & held(c).isNotNull(), F.col("cut.text")).otherwise(held(c)).alias(c) if c == column else held(c).alias(c) for c in kept]
    return whole.select(
        *columns, n_lines.alias("n_lines"), F.coalesce("cut.n_removed_lines", F.lit(0)).alias("n_removed_lines"), F.size("gone").alias("n_removed_chunks")
    )


#: The same result for the documents table in DuckDB.
ORACLE = f"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT & {(1 << FAMILIES) - 1} AS h FROM line),
pair AS (SELECT doc_id, i, h, lead(h) OVER w AS h2, line || chr(10) || lead(line) OVER w AS body FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
chunk AS (SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1 AS gone FROM pair WHERE h & (~h2) <> 0),
lost AS (SELECT doc_id, i FROM chunk WHERE gone UNION SELECT doc_id, i + 1 FROM chunk WHERE gone),
n AS (SELECT doc_id, count(*) AS n FROM chunk WHERE gone GROUP BY 1)
SELECT line.doc_id, coalesce(string_agg(line.line, chr(10) ORDER BY line.i) FILTER (WHERE lost.i IS NULL), '') AS text,
       CAST(count(*) AS INT) AS n_lines, CAST(count(lost.i) AS INT) AS n_removed_lines, CAST(coalesce(any_value(n.n), 0) AS INT) AS n_removed_chunks
FROM line LEFT JOIN lost ON lost.doc_id = line.doc_id AND lost.i = line.i LEFT JOIN n ON n.doc_id = line.doc_id GROUP BY line.doc_id
"""
