"""Dependency links (layer 4) by one shift-reduce pass over a sentence's chunks.

The pass keeps a stack. For each chunk dst in turn it pops src and links src to dst while the pair is accepted; a refused src
goes back, then dst is pushed. The last chunk accepts everything, so the links are one projective tree whose root is the last
chunk. A link made without an estimate keeps the score of the latest estimate in the sentence, 0 if there was none.

shift_reduce() is the pass as an expression, for scores that are expressions; link_sentences() is an Arrow stage for a
trained model, whose features depend on the children found on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kakari.functions.text import let
from kakari.schema import CHUNKS, chunk

LINK = "struct<src:int,dst:int,score:double,fake:boolean>"


def shift_reduce(n: Column, score: Callable[[Column, Column], Column], gold: Column | None = None) -> Column:
    """array<struct<src,dst,score,fake>> in order of src: the link of every chunk but the last.

    With gold (array<int>), as in training: a chunk without a known link (-1), met first on the stack, takes the next chunk; such
    a link is fake, and gold links decide all others, score +1 or -1.
    """

    def step(state, dst):
        top = F.get(state["stack"], F.lit(0))
        last = dst == n - 1
        fake = F.lit(False) if gold is None else ~last & F.coalesce(F.get(gold, top) == -1, F.lit(False))

        def one(acc, src):
            given = F.lit(None).cast("double") if gold is None else F.when(F.get(gold, src) == dst, 1.0).otherwise(-1.0)
            estimate = (score(src, dst) if gold is None else given).cast("double")
            new = F.when(last | fake, acc["latest"]).otherwise(estimate)

            def judged(s):
                ok = last | fake | F.coalesce(s > 0, F.lit(False))
                link = F.struct(src.cast("int").alias("src"), dst.cast("int").alias("dst"), s.alias("score"), fake.alias("fake"))
                return F.struct((~ok).alias("stopped"), (acc["popped"] + F.when(ok, 1).otherwise(0)).alias("popped"), F.when(ok, F.concat(acc["made"], F.array(link))).otherwise(acc["made"]).alias("made"), F.coalesce(s, acc["latest"]).alias("latest"))

            return F.when(acc["stopped"], acc).otherwise(let(new, judged))

        start = F.struct(F.lit(False).alias("stopped"), F.lit(0).alias("popped"), F.array().cast(f"array<{LINK}>").alias("made"), state["latest"].alias("latest"))

        def moved(x):
            rest = F.slice(state["stack"], x["popped"] + 1, F.size(state["stack"]))
            return F.struct(F.concat(F.array(dst.cast("int")), rest).alias("stack"), F.concat(state["links"], x["made"]).alias("links"), x["latest"].alias("latest"))

        return let(F.aggregate(state["stack"], start, one), moved)

    first = F.struct(F.array(F.lit(0)).alias("stack"), F.array().cast(f"array<{LINK}>").alias("links"), F.lit(0.0).alias("latest"))
    order = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.aggregate(order, first, step, lambda s: s["links"]))


def with_links(chunks: Column, links: Column) -> Column:
    """chunks with the links and scores of shift_reduce(); the root keeps what it had, a lone chunk gets -1 and 0."""

    def one(c, i):
        found = F.get(links, i)
        alone = F.size(chunks) == 1
        link, score = F.when(alone, -1).otherwise(F.coalesce(found["dst"], c["link"])), F.when(alone, 0.0).otherwise(F.coalesce(found["score"], c["score"].cast("double")))
        return chunk(link, c["head_pos"], c["func_pos"], c["token_pos"], c["token_size"], score, c["features"])

    return F.transform(chunks, one)


def link_by(df: DataFrame, score: Callable[[Column, Column], Column], respect_links: bool = False) -> DataFrame:
    """df with links by an expression score(src, dst) over its columns. respect_links takes given links (other than -1) as decided."""

    def every(chunks):
        given = F.transform(chunks, lambda c: c["link"])

        def linked(known):
            def scored(src, dst):
                if not respect_links:
                    return score(src, dst)
                at = F.get(known, src)
                return F.when(at == -1, score(src, dst)).when(at == dst, F.lit(1.0)).otherwise(F.lit(-1.0))

            return let(shift_reduce(F.size(known), scored), lambda links: with_links(chunks, links))

        return let(given, linked)

    return df.withColumn("chunks", let(F.col("chunks"), every))


def fold(n: int, accepts: Callable[[int, int, list[list[int]]], tuple[bool, float]], fake: Callable[[int], bool] = lambda src: False) -> tuple[list[int], list[float]]:
    """The same pass as a plain loop: links and scores of chunks 0..n-2; accepts(src, dst, children) estimates a pair."""
    link, scores, children = [-1] * n, [0.0] * n, [[] for _ in range(n)]
    stack, latest = [0], 0.0
    for dst in range(1, n):
        free = dst != n - 1 and fake(stack[-1])
        while stack:
            src = stack[-1]
            if dst != n - 1 and not free:
                ok, latest = accepts(src, dst, children)
                if not ok:
                    break
            stack.pop()
            link[src], scores[src] = dst, latest
            if not free:
                children[dst].append(src)
        stack.append(dst)
    return link[: n - 1], scores[: n - 1]


def roles(features: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {k: [] for k in "FLRGA"}
    for x in features:
        if x[:1] in out:
            out[x[0]].append(x)
    return out


def gathered(chunks: list[dict[str, list[str]]], src: int, dst: int, children: list[list[int]]) -> set[str]:
    """The features of a pair, those of the children found so far among them."""
    gap = dst - src
    out = {"DIST:1" if gap == 1 else "DIST:2-5" if gap <= 5 else "DIST:6-"}
    out.update("S" + x[1:] for x in chunks[src]["F"])
    out.update("D" + x[1:] for x in chunks[dst]["F"])
    if src > 0:
        out.update(chunks[src - 1]["L"])
    if dst < len(chunks) - 1:
        out.update(chunks[dst + 1]["R"])
    for of, letter in ((src, "a"), (dst, "A")):
        for k in children[of]:
            out.update(letter + x[1:] for x in chunks[k]["A"])
    between = [x for k in range(src + 1, dst) for x in chunks[k]["G"]]
    out.update(x for x in between if x not in ("GOB:1", "GCB:1"))
    opened, closed = "GOB:1" in between, "GCB:1" in between
    out.add("GBB:1" if opened and closed else "GOB:1" if opened else "GCB:1" if closed else "GNB:1")
    return out


def link_sentences(df: DataFrame, model) -> DataFrame:
    """df with links under a model (kakari.operators.model.PairModel), which is broadcast; rows stay where they are.

    0 chunks: nothing; 1 chunk: link -1, score 0. The root keeps its given link and score.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        scorer = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("chunks")
            rows = batch.column(at).to_pylist()
            for row in rows:
                if not row:
                    continue
                if len(row) == 1:
                    row[0]["link"], row[0]["score"] = -1, 0.0
                    continue
                parts = [roles(c["features"] or []) for c in row]
                judge = lambda s, d, kids, parts=parts: (lambda v: (v > 0, v))(scorer.score(gathered(parts, s, d, kids)))
                for c, link, score in zip(row, *fold(len(row), judge)):
                    c["link"], c["score"] = link, score
            yield pa.RecordBatch.from_arrays([pa.array(rows, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return df.withColumn("chunks", F.col("chunks").cast(f"array<{CHUNKS}>")).mapInArrow(run, df.schema)


def depth_of(links: Column) -> Column:
    """For each chunk, how many links lead from it to its root. Links must lead to later chunks or be -1."""

    def step(acc, link):
        # from the last chunk to the first; acc holds the depths of the chunks after this one, the nearest first
        own = F.when(link == -1, 0).otherwise(F.get(acc, link - (F.size(links) - F.size(acc))) + 1)
        return F.concat(F.array(own.cast("int")), acc)

    return F.aggregate(F.reverse(links), F.array().cast("array<int>"), step)
