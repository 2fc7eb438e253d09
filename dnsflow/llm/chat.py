"""Chat formatting of reply trees, in DataFrame operations alone.

A tree is a set of messages with a parent each. ``branches`` enumerates the root-to-leaf paths by
iterative self-joins that double the distance in each round, so a chain of n messages takes
log2(n) rounds, ranks the paths of a tree by their score and keeps the best. ``format_paths`` writes each
path as one conversation with a loss mask; ``read_turns`` reads conversations back.

The template is ``<turn ROLE>`` newline ``TEXT</turn>`` newline. In texts ``\\`` is written ``\\b`` and
``<`` ``\\l``, in roles ``>`` is ``\\g`` as well, so no text can hold a mark and the escapes can be undone.
The loss mask is a list of run lengths in code points: not learned, learned, not learned, ..., one
pair of runs per turn; a last run covers the end.

Nulls: a null text or role is empty; a null tree id is a tree of its own. A parent that does not
exist makes its child a root. Messages that never reach a root (cycles) belong to no path. Messages
with one tree and node id keep one of the rows (the smallest). A conversation is one value by
definition, so the texts of one path meet in one row; everything before that is spread by message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnsflow.operators.scale import materialize

END = "</turn>\n"


def escape(text: Column, also_close: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(">"), F.lit("\\g")) if also_close else out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def chain(rows: DataFrame, tree: str, turn: str, role: str = "role", text: str = "text") -> DataFrame:
    """Messages of linear conversations: each row answers the one before it, by (turn, role, text)."""
    place = F.row_number().over(Window.partitionBy(tree).orderBy(turn, role, text))
    return rows.select(
        F.col(tree).alias("tree"), place.cast("long").alias("node"), F.col(role).alias("role"),
        F.col(text).alias("text"), F.lit(0.0).alias("score"),
    ).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def branches(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """The ``keep`` best root-to-leaf paths of each tree.

    ``nodes``: tree, node, parent, role, text, score. Paths rank by the mean score of their messages, null
    counting as 0, then the longer path, then the smaller leaf. Returns tree, leaf, rank, place (0 at the
    root), role, text.
    """
    one = Window.partitionBy("_tree", "node").orderBy("parent", "role", "text", "score")
    kept = materialize(
        nodes.withColumn("_tree", F.to_json(F.struct("tree")))
        .where(F.col("node").isNotNull())
        .withColumn("_copy", F.row_number().over(one)).where("_copy = 1").drop("_copy")
    )
    ids = kept.select("_tree", F.col("node").alias("up"))
    links = materialize(
        kept.select("_tree", "node", F.col("parent").alias("up")).where("up is not null").join(ids, ["_tree", "up"])
    )
    # Members of each leaf's path, with their distance from the leaf.
    paths = materialize(
        kept.select("_tree", "node")
        .join(links.select("_tree", F.col("up").alias("node")).distinct(), ["_tree", "node"], "left_anti")
        .select("_tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    )
    largest = kept.groupBy("_tree").count().agg(F.max("count")).first()[0] or 0
    hop, distance = links, 1
    while distance <= largest and not hop.isEmpty():
        further = paths.join(hop, ["_tree", "node"]).select(
            "_tree", "leaf", F.col("up").alias("node"), (F.col("back") + distance).alias("back"))
        paths = materialize(paths.unionByName(further))
        twice = hop.select("_tree", F.col("node").alias("start"), F.col("up").alias("node")).join(hop, ["_tree", "node"])
        hop, distance = materialize(twice.select("_tree", F.col("start").alias("node"), "up")), distance * 2
    endless = hop.select("_tree", F.col("node").alias("leaf"))    # still climbing after as many steps as there are nodes
    paths = paths.join(endless, ["_tree", "leaf"], "left_anti")
    members = paths.join(kept.select("_tree", "node", "tree", "role", "text", "score"), ["_tree", "node"])
    scores = paths.join(kept.select("_tree", "node", "score"), ["_tree", "node"]).groupBy("_tree", "leaf").agg(
        F.avg(F.coalesce("score", F.lit(0.0))).alias("path_score"), F.count(F.lit(1)).alias("length"))
    best = Window.partitionBy("_tree").orderBy(F.col("path_score").desc(), F.col("length").desc(), "leaf")
    chosen = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    return members.join(chosen, ["_tree", "leaf"]).select(
        "tree", "leaf", "rank", (F.col("length") - 1 - F.col("back")).alias("place"), "role", "text")


def format_paths(paths: DataFrame, learn: str = "assistant") -> DataFrame:
    """One conversation per path: tree, leaf, rank, formatted, loss_runs (turns of role ``learn`` are learned)."""
    head = F.concat(F.lit("<turn "), escape(F.coalesce("role", F.lit("")), True), F.lit(">\n"))
    body = escape(F.coalesce("text", F.lit("")))
    learned = F.coalesce(F.col("role") == learn, F.lit(False))
    size = F.char_length
    turn = F.struct(
        F.col("place"), F.concat(head, body, F.lit(END)).alias("turn"),
        F.when(learned, size(head)).otherwise(size(F.concat(head, body, F.lit(END)))).cast("long").alias("skipped"),
        F.when(learned, size(body)).otherwise(F.lit(0)).cast("long").alias("learned"),
        F.when(learned, F.lit(len(END))).otherwise(F.lit(0)).cast("long").alias("rest"),
    )
    turns = paths.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    # What follows a learned text belongs to the next run that is not learned.
    before = F.concat(F.array(F.lit(0).cast("long")), F.col("t.rest"))
    pair = F.transform("t", lambda x, i: F.array(x["skipped"] + F.get("before", i), x["learned"]))
    return turns.withColumn("before", before).select(
        "tree", "leaf", "rank", F.array_join("t.turn", "").alias("formatted"),
        F.concat(F.flatten(pair), F.array(F.element_at("before", -1))).alias("loss_runs"))


def read_turns(conversations: DataFrame) -> DataFrame:
    """Read formatted conversations back; adds turns (role, text) and learned, the text under the mask."""
    pieces = F.split("formatted", END)
    head = "^<turn ([^>]*)>\n"
    parsed = F.transform(
        F.slice("pieces", F.lit(1), F.size("pieces") - 1),
        lambda p: F.struct(
            unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")))
    masked = F.transform(
        F.slice("pieces", F.lit(1), F.size("pieces") - 1),
        lambda p, i: F.right(p, F.get("loss_runs", 2 * i + 1).cast("int")))
    return conversations.withColumn("pieces", pieces).withColumn("turns", parsed).withColumn(
        "learned", unescape(F.array_join(masked, ""))).drop("pieces")
