"""Near duplicates by a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets are merged first. Independent trees then branch the
remaining sets: at a node one or two coordinates of the minwise signature are chosen from the
node's path, and a set goes to the child named by its minimum there (1.25 children on average,
so a pair of similarity 0.8 keeps one common child per level). Nodes of few sets are compared
exhaustively on signatures; larger ones branch on. Sets that look similar form candidate
groups, and inside a group the links are confirmed on the full sets.

Hot groups: a node that stays large to the last level, and a candidate group above its bound, are
dealt in blocks that share a few pivots; what the pivots leave apart is then compared block by
block. Only a spanning forest of links leaves a task, never all pairs.

Defined cases: null, empty and wordless texts have no shingles, are linked with nothing and are kept;
a text shorter than a shingle is one shingle of all its words; rows that repeat an id are one document (of
different texts that with the lowest set digest counts); rows without an id are left out, as
they name no document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.functions.grouped import groups
from airlattice.llm.common import Scratch, small_batches
from airlattice.llm.graph import components
from airlattice.llm.shingles import minima, shingles

COORDINATES = 128      # minwise signature
TREES = 10             # misses a pair of similarity 0.8 with probability below 2e-4 at depth 4
LEVELS = 4
NODE = 128             # sets compared exhaustively
PIVOTS = 8
PART = 1024            # sets of a block of a larger node, compared with another such block in one task
GROUP_WORDS = 1 << 21  # shingles of a group confirmed in one task
BLOCK_WORDS = 1 << 19  # shingles of a block of a larger group
BROADCAST_ROWS = 200_000   # candidate rows of some 50 bytes each sent to every task; above, a shuffle join
SLACK = 0.14           # four standard deviations of the signature's estimate


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, content (digest of the set), low (minwise signature),
    sketch (8 bits of each minimum, enough to compare: they agree by chance once in 256)."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            n, content, low, sketch = [], [], [], []
            for text in pdf["text"]:
                s = shingles(text, k)
                m = minima(s, COORDINATES)
                n.append(len(s))
                content.append(digest(s) if len(s) else None)
                low.append(m.view(np.int32) if len(s) else None)
                sketch.append((m * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": np.array(n, np.int64),
                                "content": content, "low": low, "sketch": sketch})
    return docs.mapInPandas(work, "doc_id long, n_shingles long, content binary, low array<int>, sketch binary")


def digest(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _leaves(reps: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(node, doc_id): the nodes in which sets are compared, at least two sets each; and with their size n
    those that are still large at the last level."""
    path = F.col("path")
    step = F.pmod(F.xxhash64(path, F.lit(1)), F.lit(COORDINATES)).cast("int")
    other = F.pmod(F.xxhash64(path, F.lit(2)), F.lit(COORDINATES)).cast("int")
    twice = F.pmod(F.xxhash64(path, F.lit(3)), F.lit(4)) == 0

    def children(rows: DataFrame) -> DataFrame:
        """One or two children of every (path, doc_id, low)."""
        chosen = F.when(twice & (step != other), F.array(step, other)).otherwise(F.array(step))
        return (rows.withColumn("c", F.explode(chosen))
                .select(F.xxhash64("path", "c", F.expr("element_at(low, c + 1)")).alias("node"), "doc_id"))
    roots = reps.select("doc_id", "low", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")) \
        .select("doc_id", "low", F.xxhash64(F.lit("tree"), "tree").alias("path"))
    rows, done, large = children(roots), [], None
    for level in range(LEVELS):
        rows = scratch.save(rows, f"nodes-{level}")
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = scratch.save(rows.join(sizes, "node"), f"sized-{level}")
        scratch.drop(f"nodes-{level}")
        done.append(sized.where(F.col("n") <= NODE).select("node", "doc_id"))
        big = sized.where(F.col("n") > NODE)
        if big.isEmpty():
            break
        if level == LEVELS - 1:
            large = big.select("node", "doc_id", "n")
            break
        rows = children(big.select(F.col("node").alias("path"), "doc_id").join(reps.select("doc_id", "low"), "doc_id"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, large


def _blocks(big: DataFrame) -> DataFrame:
    """Nodes that stay large: blocks by a seeded hash, with a few sets of the node in every block."""
    n_blocks = F.ceil(F.col("n") / NODE).cast("long")
    dealt = big.select("node", "doc_id", n_blocks.alias("n_blocks"), F.xxhash64("node", "doc_id").alias("h"), "n")
    own = dealt.select("node", "doc_id", F.pmod("h", "n_blocks").alias("block"))
    # About PIVOTS sets of a node, whatever its size.
    pivots = (dealt.where(F.pmod(F.xxhash64("h"), F.col("n")) < PIVOTS)
              .select("node", "doc_id", F.explode(F.expr("sequence(0L, n_blocks - 1)")).alias("block")))
    return own.unionByName(pivots).distinct().select(F.xxhash64("node", "block").alias("node"), "doc_id")


def _rest(large: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(node, doc_id, known): units in which all sets of a large node meet that ``labels`` (id, component) do not join yet.

    What is apart from the largest component of its node is dealt in parts; each part meets every other
    part and every block of the largest component.
    """
    named = scratch.save(
        large.select("node", "doc_id").join(labels.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
        .select("node", "doc_id", F.coalesce("component", "doc_id").alias("known")), "nodes-named")
    sizes = named.groupBy("node", "known").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("node").agg(F.max(F.struct("n", "known")).alias("main"), F.sum("n").alias("n")).select(
        "node", F.col("main.known").alias("main"), F.ceil(F.col("main.n") / PART).cast("long").alias("n_blocks"),
        F.ceil((F.col("n") - F.col("main.n")) / PART).cast("long").alias("n_parts")).where("n_parts > 0")
    dealt = scratch.save(named.join(most, "node").withColumn("h", F.xxhash64(F.lit(9), "node", "doc_id")), "nodes-dealt")
    if dealt.isEmpty():
        return None
    every_part = F.expr("sequence(0L, n_parts - 1)")
    apart = dealt.where("known <> main").withColumn("part", F.expr("pmod(h, n_parts)"))
    with_main = (apart.select("node", "doc_id", "known", "part", F.explode(F.expr("sequence(0L, n_blocks - 1)")).alias("block"))
                 .unionByName(dealt.where("known = main").withColumn("block", F.expr("pmod(h, n_blocks)"))
                              .select("node", "doc_id", "known", F.explode(every_part).alias("part"), "block"))
                 .select(F.xxhash64("node", F.lit("main"), "part", "block").alias("node"), "doc_id", "known"))
    among = (apart.select("node", "doc_id", "known", "part", F.explode(every_part).alias("other"))
             .select(F.xxhash64("node", F.least("part", "other"), F.greatest("part", "other")).alias("node"), "doc_id", "known"))
    return with_main.unionByName(among)


def _alike(leaves: DataFrame, large: DataFrame | None, reps: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): links whose components join, in every node, all pairs whose signatures look similar."""
    need = int(np.floor((similarity - SLACK) * COORDINATES))
    bytes_ = np.uint64(0x0101010101010101)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for pdf in groups(frames, "node"):
            ids = pdf["doc_id"].to_numpy()
            m = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(ids), COORDINATES)
            # Sets of one known component are joined already and reached together.
            _, label = np.unique(pdf["known"].to_numpy(), return_inverse=True)
            order = np.argsort(label, kind="stable")
            at = np.searchsorted(label[order], np.arange(label.max() + 2))
            left = np.arange(len(ids))
            while len(left):
                own = int(label[left[0]])
                open_ = order[at[own]:at[own + 1]].tolist()
                left = left[label[left] != own]
                while open_ and len(left):
                    x = open_.pop()
                    same = (m[left] == m[x]).view(np.uint64).sum(1, dtype=np.uint64)
                    near = left[same * bytes_ >> np.uint64(56) >= need]
                    if not len(near):
                        continue
                    new, one = np.unique(label[near], return_index=True)
                    for y in near[one].tolist():
                        a.append(ids[x]), b.append(ids[y])
                    for c in new.tolist():
                        open_ += order[at[c]:at[c + 1]].tolist()
                    left = left[~np.isin(label[left], new)]
            if len(a) > 20_000:
                yield pd.DataFrame({"a": a, "b": b})
                a, b = [], []
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    def linked(nodes: DataFrame) -> DataFrame:
        rows = nodes.join(reps.select("doc_id", "sketch"), "doc_id").repartition("node").sortWithinPartitions("node")
        return rows.select("node", "doc_id", "known", "sketch").mapInPandas(compare, "a long, b long")
    if large is None:
        return scratch.save(linked(leaves.withColumn("known", F.col("doc_id"))), "alike")
    first = scratch.save(linked(leaves.unionByName(_blocks(large)).withColumn("known", F.col("doc_id"))), "alike-pivots")
    rest = _rest(large, components(first, scratch, "alike-labels"), scratch)
    return first if rest is None else first.unionByName(scratch.save(linked(rest), "alike-rest"))


def _confirm_group(ids: np.ndarray, sets: list[np.ndarray], percent: int,
                   known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (100 * intersection >= percent * union) that join the sets of one bounded group.

    From set to set: each is matched with all those not yet reached, so every set ends in the
    right component although pairs that are already joined are not compared.
    ``known`` gives components that are already joined.
    """
    n = len(ids)
    size = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(code.max()) + 1, bool)
    label = np.arange(n) if known is None else np.asarray(known)
    members: dict[int, list[int]] = {}
    for i, c in enumerate(label.tolist()):
        members.setdefault(c, []).append(i)
    links = []
    left, flat = np.arange(n), code     # not yet reached, and their shingles one after another

    def reach(who: list[int]) -> None:
        nonlocal left, flat
        stay = ~np.isin(left, who)
        flat = flat[np.repeat(stay, size[left])]
        left = left[stay]
    while len(left):
        todo = list(members[int(label[left[0]])])
        reach(todo)
        while todo and len(left):
            x = todo.pop()
            mine = code[at[x]:at[x + 1]]
            mark[mine] = True
            both = np.add.reduceat(mark[flat], np.concatenate([[0], np.cumsum(size[left])[:-1]]), dtype=np.int64)
            mark[mine] = False
            hit = left[100 * both >= percent * (size[x] + size[left] - both)]
            if len(hit):
                new: set[int] = set()
                for y in hit.tolist():
                    if y not in new:
                        links.append((int(ids[x]), int(ids[y])))
                        new.update(members[int(label[y])])
                todo.extend(new)
                reach(list(new))
    return links


def confirm(docs: DataFrame, suspects: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """(doc_id, component, n_shingles, content) candidate groups -> (a, b) links true on the full sets."""
    n_suspects = suspects.count()
    totals = suspects.groupBy("component").agg(F.sum("n_shingles").alias("total"), F.count(F.lit(1)).alias("n"))
    blocks = F.when(F.col("total") <= GROUP_WORDS, F.lit(1)).otherwise(F.ceil(F.col("total") / BLOCK_WORDS)).cast("long")
    dealt = suspects.join(totals.select("component", blocks.alias("n_blocks")), "component").select(
        "doc_id", "component", "content", "n_blocks", F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).alias("block"))
    dealt = scratch.save(dealt, "dealt")
    if n_suspects <= BROADCAST_ROWS:
        dealt = F.broadcast(dealt)

    def sets_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sets = [shingles(t, k) for t in pdf["text"]]
            out = pdf.drop(columns=["text", "content"])
            out["shingles"] = [s.tobytes() for s in sets]
            # Of an id repeated with other texts, only the set that counts.
            yield out[[digest(s) == bytes(c) for s, c in zip(sets, pdf["content"])]]
    full = scratch.save(
        docs.join(dealt, "doc_id").mapInPandas(
            sets_of, "doc_id long, component long, n_blocks long, block long, shingles binary"), "suspect-sets")

    def links_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in groups(frames, "unit"):
            ids = pdf["doc_id"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
            known = pdf["known"].to_numpy() if "known" in pdf else None
            if known is not None:
                _, known = np.unique(known, return_inverse=True)
            found = _confirm_group(ids, sets, percent, known)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    def matched(rows: DataFrame, *more: str) -> DataFrame:
        return (rows.repartition("unit").sortWithinPartitions("unit")
                .select("unit", "doc_id", "shingles", *more).mapInPandas(links_of, "a long, b long"))
    whole = full.where("n_blocks = 1").withColumn("unit", F.col("component"))
    links = scratch.save(matched(whole), "links-whole")
    large = full.where("n_blocks > 1")
    if large.isEmpty():
        return links

    # Large groups: every block also gets the group's pivots, its sets of lowest hash.
    span = F.col("n_blocks")
    unit = F.xxhash64("component", "block")
    chosen = (large.select("component", "n_blocks", F.struct(F.xxhash64(F.lit(5), "doc_id").alias("h"), "doc_id").alias("p"))
              .groupBy("component").agg(F.max("n_blocks").alias("n_blocks"), F.min("p").alias("p"))
              .select("component", F.col("p.doc_id").alias("doc_id")))
    for salt in range(6, 5 + PIVOTS):
        chosen = chosen.unionByName(
            large.select("component", F.struct(F.xxhash64(F.lit(salt), "doc_id").alias("h"), "doc_id").alias("p"))
            .groupBy("component").agg(F.min("p").alias("p")).select("component", F.col("p.doc_id").alias("doc_id")))
    pivots = (large.join(chosen.distinct(), ["component", "doc_id"])
              .select("doc_id", "component", "n_blocks", F.explode(F.expr("sequence(0L, n_blocks - 1)")).alias("block"), "shingles"))
    own = large.select("doc_id", "component", "n_blocks", "block", "shingles")
    round1 = own.unionByName(pivots).dropDuplicates(["component", "block", "doc_id"]).withColumn("unit", unit)
    first = scratch.save(matched(round1), "links-pivots")
    joined = components(first, scratch, "pivot-labels")
    named = scratch.save(
        large.select("doc_id", "component", "n_blocks", "block")
        .join(joined.select(F.col("id").alias("doc_id"), F.col("component").alias("j")), "doc_id", "left")
        .withColumn("known", F.coalesce("j", "doc_id")).drop("j"), "named")
    most = (named.groupBy("component", "known").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("component").agg(F.max_by("known", F.struct("n", "known")).alias("main")))
    apart = named.join(most, "component").where("known <> main").select("doc_id", "component", "n_blocks", "known")
    if apart.isEmpty():
        return links.unionByName(first)
    # What is apart from the main part, in blocks of its own, against every block of its group.
    lone = apart.withColumn("part", F.pmod(F.xxhash64(F.lit(9), "doc_id"), span))
    shingle = large.select("doc_id", "shingles")
    parts = lone.select("component", "part").distinct()
    every = named.join(parts, "component").select("doc_id", "component", "known", "block", "part")
    asked = lone.select("doc_id", "component", "known", "part", "n_blocks").withColumn(
        "block", F.explode(F.expr("sequence(0L, n_blocks - 1)"))).select("doc_id", "component", "known", "block", "part")
    round2 = every.unionByName(asked).dropDuplicates(["component", "block", "part", "doc_id"]) \
        .join(shingle, "doc_id").withColumn("unit", F.xxhash64("component", "block", "part"))
    last = scratch.save(matched(round2, "known"), "links-rest")
    return links.unionByName(first).unionByName(last)


def near_duplicates(docs: DataFrame, scratch: Scratch, *, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    signed = scratch.save(signatures(texts, words), "signatures")
    again = signed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("least")).where("n > 1")
    if not again.isEmpty():
        signed = scratch.save(
            signed.join(again.select("doc_id", "least"), "doc_id", "left")
            .where("least IS NULL OR content = least").dropDuplicates(["doc_id"]).drop("least"), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("content").agg(F.min("doc_id").alias("first"))
    member = scratch.save(
        signed.select("doc_id", "n_shingles", "content").join(classes, "content", "left")
        .select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("first")), "members")
    reps = scratch.save(
        signed.join(member.where("doc_id = first AND n_shingles > 0").select("doc_id"), "doc_id", "left_semi"),
        "representatives")
    scratch.drop("signatures")
    alike = _alike(*_leaves(reps, scratch), reps, percent / 100, scratch)
    suspects = components(alike, scratch, "suspects").select(F.col("id").alias("doc_id"), "component") \
        .join(reps.select("doc_id", "n_shingles", "content"), "doc_id")
    links = confirm(texts, scratch.save(suspects, "suspect-groups"), words, percent, scratch)
    joined = components(links, scratch, "joined")
    out = member.join(joined.select(F.col("id").alias("first"), "component"), "first", "left") \
        .withColumn("component_id", F.coalesce("component", "first"))
    out = scratch.save(out.select("doc_id", "n_shingles", "component_id",
                                  (F.col("doc_id") == F.col("component_id")).alias("kept")), "near-duplicates")
    scratch.close(keep=("near-duplicates",))
    return out
