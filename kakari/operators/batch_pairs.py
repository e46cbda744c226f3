"""Features of pairs of chunks for whole batches, and of the pairs that the link model is trained on.

A pair's features come in parts whose first letters differ, so a pair's sorted features are its parts, sorted each, one after the other;
those of a chunk are made once for all its pairs. What lies between two chunks is made of the trees that hang there, as links lead
forward and don't cross, so gaps are unions of unions and long sentences take no more than their length.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np

from kakari.operators.batch import Chunks


class Parts:
    """A chunk's features by role: own (F, without the letter), left (L), right (R), gap (G), seen (A, without the letter)."""

    __slots__ = ("own", "left", "right", "gap", "seen", "as_src", "as_dst")

    def __init__(self, features: list[str]):
        own = {x[1:] for x in features if x[0] == "F"}
        left, right, seen, gap = set(), set(), set(), set()
        for x in [x for x in features if x[0] != "F"]:
            c = x[0]
            if c == "G":
                gap.add(x)
            elif c == "R":
                right.add(x)
            elif c == "L":
                left.add(x)
            elif c == "A":
                seen.add(x[1:])
        self.own, self.gap, self.seen = sorted(own), gap, seen
        self.left, self.right = "|".join(sorted(left)), "|".join(sorted(right))
        self.as_src, self.as_dst = "|".join(["S" + x for x in self.own]), {}

    def dst(self, gap: int) -> str:
        """The features as those of a pair's second chunk, with the distance among them."""
        name = "IST:1" if gap == 1 else "IST:2-5" if gap <= 5 else "IST:6-"
        made = self.as_dst.get(name)
        if made is None:
            own = list(self.own)
            insort(own, name)
            made = self.as_dst[name] = "|".join(["D" + x for x in own])
        return made


NONE_BETWEEN = "GNB:1"


def gap_text(between: set[str]) -> str:
    if not between:
        return NONE_BETWEEN
    opened, closed = "GOB:1" in between, "GCB:1" in between
    state = "GBB:1" if opened and closed else "GOB:1" if opened else "GCB:1" if closed else "GNB:1"
    own = {x for x in between if x != "GOB:1" and x != "GCB:1"}
    own.add(state)
    return "|".join(sorted(own))


def pair_text(parts: list[Parts], a: int, b: int, src: int, dst: int, between: str, src_kids: set[str] | None = None, dst_kids: set[str] | None = None) -> str:
    """The sorted distinct features of a pair of the sentence whose chunks are a..b-1, joined by |; src and dst count through the piece."""
    out = []
    if dst_kids:
        out.append("|".join(["A" + x for x in sorted(dst_kids)]))
    out += (parts[dst].dst(dst - src), between)
    if src > a and parts[src - 1].left:
        out.append(parts[src - 1].left)
    if dst < b - 1 and parts[dst + 1].right:
        out.append(parts[dst + 1].right)
    if parts[src].as_src:
        out.append(parts[src].as_src)
    if src_kids:
        out.append("|".join(["a" + x for x in sorted(src_kids)]))
    return "|".join(out)


def linked_pairs(c: Chunks, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(src, dst), counted through the piece: each chunk with the next one, and with the one it links to, if that is another."""
    here = np.arange(len(c.at))
    nxt = here[c.id < c.n - 1]
    to = c.off[c.sent] + link
    far = here[link > c.id + 1]
    src, dst = np.concatenate([nxt, far]), np.concatenate([nxt + 1, to[far]])
    order = np.lexsort((dst, src))
    return src[order], dst[order]


def static_texts(c: Chunks, features: list[list[str]], link: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """linked_pairs() and their features, without children. Links lead forward and don't cross."""
    parts = [Parts(x) for x in features]
    links, off = link.tolist(), c.off.tolist()
    between: dict[tuple[int, int], str] = {}
    for a, b in zip(off, off[1:]):
        kids: list[list[int]] = [[] for _ in range(b - a)]
        below: list[set[str] | None] = [None] * (b - a)
        for i in range(b - a):
            gap: set[str] | None = None
            for k in reversed(kids[i]):
                if gap is None:
                    gap = below[k]
                    if i - k > 1:
                        raise ValueError("links cross")
                else:
                    between[a + k, a + i] = gap_text(gap)
                    gap |= below[k]
                below[k] = None
            below[i] = parts[a + i].gap if gap is None else gap | parts[a + i].gap
            to = links[a + i]
            if to >= 0:
                kids[to].append(i)
    src, dst = linked_pairs(c, link)
    edges = c.off[c.sent[src]]
    rows = zip(edges.tolist(), (edges + c.n[src]).tolist(), src.tolist(), dst.tolist())
    return src, dst, [pair_text(parts, a, b, s, d, between[s, d] if d - s > 1 else NONE_BETWEEN) for a, b, s, d in rows]


def examples(c: Chunks, features: list[list[str]], gold: np.ndarray) -> Iterator[tuple[int, int, int, int, str]]:
    """(sentence, src, dst, label, features) of every pair that the pass visits with the gold links, as train.link_examples() has them."""
    parts = [Parts(x) for x in features]
    links, off = gold.tolist(), c.off.tolist()
    for s, (a, b) in enumerate(zip(off, off[1:])):
        n = b - a
        if n < 2:
            continue
        kids: list[set[str]] = [set() for _ in range(n)]
        below: list[set[str]] = [set(parts[a + i].gap) for i in range(n)]
        stack = [0]
        for dst in range(1, n - 1):
            between: set[str] = set()
            if links[a + dst - 1] == -1:
                # a chunk without a known link takes the next one, with all that wait behind it, and gives no example
                for src in stack:
                    below[dst] |= below[src]
                stack = [dst]
                continue
            found: set[str] = set()
            while stack:
                src = stack[-1]
                right = links[a + src] == dst
                text = pair_text(parts, a, b, a + src, a + dst, gap_text(between), kids[src], found)
                yield s, src, dst, 1 if right else -1, text
                if not right:
                    break
                stack.pop()
                between |= below[src]
                found |= parts[a + src].seen
            kids[dst] |= found
            below[dst] |= between
            stack.append(dst)


class Scorer:
    """A PairModel's scores of pairs by ids: the weights of the frequent ids and their pairs in one symmetric square, those of other pairs by their ids."""

    def __init__(self, model):
        self.ids, self.n, self.w0, self.factor = model.ids, len(model.square), model.w0, model.factor
        self.twice = model.square + model.square.T
        np.fill_diagonal(self.twice, 2 * model.w1[: self.n])
        self.flat, self.w1, self.rare = self.twice.ravel(), model.w1.tolist(), {}
        for (i, j), w in model.rare.items():
            self.rare.setdefault(j, {})[i] = w

    def score(self, own: list[int]) -> float:
        """The score of different ids."""
        low = np.array([i for i in own if i < self.n], np.int64)
        total = self.w0 + int(self.flat.take((low * self.n)[:, None] + low).sum(dtype=np.int64)) // 2
        if len(low) < len(own):
            for j in own:
                if j >= self.n:
                    total += self.w1[j]
                    with_j = self.rare.get(j)
                    if with_j:
                        total += sum([with_j.get(i, 0) for i in own])
        return total * self.factor


def model_links(c: Chunks, features: list[list[str]], model) -> np.ndarray:
    """The links of each chunk under a PairModel, as links.link_sentences() gives them; the root has -1."""
    scorer = model.__dict__.get("_scorer")
    if scorer is None:
        scorer = model.__dict__["_scorer"] = Scorer(model)
    get = scorer.ids.get
    known = lambda names: [i for i in map(get, names) if i is not None]
    gap_ids = {x: get(x) for x in ("DIST:1", "DIST:2-5", "DIST:6-", "GNB:1", "GOB:1", "GCB:1", "GBB:1")}
    link, off = [-1] * len(c.at), c.off.tolist()
    for a, b in zip(off, off[1:]):
        n = b - a
        if n < 2:
            continue
        if n == 2:
            link[a] = 1
            continue
        parts = [Parts(x) for x in features[a:b]]
        # what a chunk brings to all its pairs as the first and as the second, with its neighbour's part
        side = [known(p.left.split("|")) for p in parts], [known(p.right.split("|")) for p in parts]
        first = [known(["S" + x for x in p.own]) + (side[0][i - 1] if i else []) for i, p in enumerate(parts)]
        second = [known(["D" + x for x in p.own]) + (side[1][i + 1] if i < n - 1 else []) for i, p in enumerate(parts)]
        kids: list[list[int]] = [[] for _ in range(n)]
        below = [set(p.gap) for p in parts]
        stack = [0]
        for dst in range(1, n - 1):
            between, found = set(), set()
            while stack:
                src = stack[-1]
                gap = dst - src
                opened, closed = "GOB:1" in between, "GCB:1" in between
                names = ("DIST:1" if gap == 1 else "DIST:2-5" if gap <= 5 else "DIST:6-", "GBB:1" if opened and closed else "GOB:1" if opened else "GCB:1" if closed else "GNB:1")
                own = first[src] + second[dst] + kids[src] + [i for x in names if (i := gap_ids[x]) is not None]
                own += known([x for x in between if x != "GOB:1" and x != "GCB:1"])
                if found:
                    own += known(["A" + x for x in found])
                if scorer.score(own) <= 0:
                    break
                stack.pop()
                link[a + src] = dst
                between |= below[src]
                found |= parts[src].seen
            kids[dst] = known(["a" + x for x in found])
            below[dst] |= between
            stack.append(dst)
        for src in stack:
            link[a + src] = n - 1
    return np.array(link, np.int32)
