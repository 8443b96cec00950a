"""Chat formatting of reply trees, built of DataFrame operations only.

Iterative self-joins double the reach of each node's pointer to its ancestors, and add up the scores on the way, in as many rounds as the
depth has binary digits. So every leaf's branch has its score before any path is written out; branches are
ranked by it, and only the chosen ones are enumerated from leaf to root, by the same pointers, one row for each node of a path.
Each chosen path becomes one conversation. Control strings inside texts are escaped reversibly, so a
formatted conversation can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bramble.llm.common import cut_lineage

START, END = "<|im_start|>", "<|im_end|>"
#: Doublings after which a path must have ended; a longer one is a ring.
DOUBLINGS = 40


def escaped(text: Column) -> Column:
    """No control string is left in it: backslashes are doubled, and one goes between < and |."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _pointers(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, leaf, score) of each root-to-leaf branch of nodes (tree, node, parent, score), and the pointers (tree, node, above) over 1, 2, 4, ... steps.

    A node whose parent is null, missing or itself is a root. A ring has no leaf, but if other
    nodes hang from one, their paths never end: that raises ValueError.
    """
    own = cut_lineage(nodes.groupBy("tree", "node").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score")))
    links = nodes.where("parent is not null and parent != node").groupBy("tree", "node").agg(F.min("parent").alias("above"))
    links = links.join(own.select("tree", F.col("node").alias("above")), ["tree", "above"], "left_semi")
    # A pointer has the sum of the scores that it leaps over, its own node's first.
    jumps = [cut_lineage(links.join(own, ["tree", "node"]).select("tree", "node", "above", "score"))]
    leaves = own.join(jumps[0].select("tree", F.col("above").alias("node")).distinct(), ["tree", "node"], "left_anti").select("tree", "node")
    done = own.join(jumps[0].select("tree", "node").distinct(), ["tree", "node"], "left_anti")
    while not jumps[-1].isEmpty():
        if len(jumps) > DOUBLINGS:
            raise ValueError("replies form a ring")
        jump = jumps[-1]
        # Where the pointer's end has no such pointer, the end's own branch is summed up already: each node gets its sum once.
        last = jump.join(jump.select("tree", F.col("node").alias("above")).distinct(), ["tree", "above"], "left_anti")
        last = last.join(done.select("tree", F.col("node").alias("above"), F.col("score").alias("more")), ["tree", "above"])
        done = done.unionByName(cut_lineage(last.select("tree", "node", (F.col("score") + F.col("more")).alias("score"))))
        after = jump.select("tree", F.col("node").alias("above"), F.col("above").alias("next"), F.col("score").alias("more"))
        jumps.append(cut_lineage(jump.join(after, ["tree", "above"]).select("tree", "node", F.col("next").alias("above"), (F.col("score") + F.col("more")).alias("score"))))
    return leaves.join(done, ["tree", "node"]).select("tree", F.col("node").alias("leaf"), "score"), [j.drop("score") for j in jumps[:-1]]


def ranked(branches: DataFrame) -> DataFrame:
    """(tree, leaf, score, rank): by falling score, then leaf. Rows are sorted over all tasks, so that a tree of very many leaves is ranked in several."""
    rows = branches.repartitionByRange(F.col("tree"), F.desc("score"), F.col("leaf")).withColumn("__task", F.spark_partition_id())
    rows = cut_lineage(rows)
    each = Window.partitionBy("tree", "__task").orderBy(F.desc("score"), "leaf")
    before = Window.partitionBy("tree").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("tree", "__task").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))  # a row a task at most for each tree
    return rows.withColumn("rank", F.row_number().over(each)).join(counts, ["tree", "__task"]).select("tree", "leaf", "score", (F.col("rank") + F.col("__before")).alias("rank"))


def _paths(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(tree, leaf, node, up) for each node of the path from each of the leaves to its root; up counts from the leaf."""
    paths = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, jump in enumerate(jumps):
        higher = paths.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = cut_lineage(paths.unionByName(higher))
    return paths


def format_branches(nodes: DataFrame, top: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, score, rank, n_turns, formatted, loss_spans) of the `top` best branches of each tree (None: all).

    nodes has tree, node, parent, role, text, score; a branch's score is the sum over its nodes (null: 0), ties go to the
    smaller leaf. loss_spans are the code points [start, end) of the loss role's texts in the formatted
    conversation. Null roles and texts are empty; nodes without a tree or an id are left out, for no branch
    can be told from them; nodes with an equal id are the same place, one after another by role and text, below the smallest of their parents. An empty table gives an empty table. Other columns are not looked at.
    """
    nodes = nodes.where("tree is not null and node is not null")
    branches, jumps = _pointers(nodes)
    best = ranked(branches)
    best = cut_lineage(best if top is None else best.where(F.col("rank") <= top))
    paths = _paths(best, jumps)
    turns = paths.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    turns = turns.select("tree", "leaf", "up", (F.coalesce("role", F.lit("")) == loss_role).alias("loss"), F.length(head).alias("from"), F.length(text).alias("chars"), F.concat(head, text, F.lit(END + "\n")).alias("piece"))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"), "piece").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    turns = turns.select("tree", "leaf", F.struct("at", "piece", F.when(F.col("loss"), F.struct((F.col("at") + F.col("from")).alias("start"), (F.col("at") + F.col("from") + F.col("chars")).alias("end"))).alias("span")).alias("t"))
    done = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list("t")).alias("t"))
    done = done.select("tree", "leaf", F.size("t").cast("long").alias("n_turns"), F.array_join("t.piece", "").alias("formatted"), F.filter("t.span", lambda s: s.isNotNull()).alias("loss_spans"))
    return best.join(done, ["tree", "leaf"]).select("tree", "leaf", "score", "rank", "n_turns", "formatted", "loss_spans")


def turns_of(formatted: Column) -> Column:
    """The (role, text) of each turn, read back from a formatted conversation."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2_000_000_000)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 2 - len(END))).alias("text"))

    return F.transform(pieces, turn)


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = f"{END}{START}assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    nodes = cut_lineage(rows.unionByName(more).select(F.col("conv_id").alias("tree"), place.alias("node"), "role", "text"))
    nodes = nodes.withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(1.0)})
    out = format_branches(nodes)
    turns = turns_of(F.col("formatted"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    out = out.withColumns({"turns": F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), "loss": loss})
    return out.select(F.col("tree").alias("conv_id"), "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
