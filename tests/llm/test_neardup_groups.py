"""Groups of independently edited copies and drift chains against the components of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from kakari.llm import neardup
from tests.llm.test_brute_force import weights

VOCABULARY = [f"w{i}" for i in range(3000)]


def edited(rng, words, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


def copies(rng):
    """Copies of one text, each edited for itself, so that pairs lie on both sides of the threshold."""
    base = rng.choices(VOCABULARY, k=120)
    return [edited(rng, base, 0.045) for _ in range(250)]


def chains(rng):
    """Chains in which each text edits the one before it."""
    out = []
    for _ in range(3):
        words = rng.choices(VOCABULARY, k=120)
        for _ in range(25):
            out.append(words)
            words = edited(rng, words, 0.025)
    return out


@pytest.mark.parametrize("made", [copies, chains])
def test_groups_against_all_pairs(spark, made):
    texts = [" ".join(w) for w in made(random.Random(7))]
    random.Random(8).shuffle(texts)
    counts = [weights(t) for t in texts]
    # of sets whose elements occur once, J_P is the plain Jaccard similarity
    assert all(set(c.values()) == {1} for c in counts)
    sets = [set(c) for c in counts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(sets)):
        for y in range(x):
            if find(x) != find(y) and len(sets[x] & sets[y]) >= 0.6 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, neardup.find_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    assert all(find(a) == find(b) for a, b in got.items())
    kept, least = len(texts) - len(got), sum(find(i) == i for i in range(len(texts)))
    print(made.__name__, len(texts), "kept", kept, "all pairs", least)
    assert kept <= least + 0.02 * len(texts)


def test_components_agree(spark):
    """On the driver and in Spark, with null doc_ids."""
    rng = random.Random(3)
    node = lambda: (rng.choice([None, *range(12)]), rng.randint(0, 1))
    edges = spark.createDataFrame([(node(), node()) for _ in range(14)], "a struct<doc_id:long,h:long>, b struct<doc_id:long,h:long>").where(F.col("a") != F.col("b"))
    one, other = (sorted(map(tuple, neardup.components(edges, n).collect()), key=repr) for n in (100, 0))
    assert one and one == other
    half = neardup.merged(neardup.components(edges.where("a.h = 0")), edges.where("a.h = 1"))
    assert sorted(map(tuple, half.collect()), key=repr) == one
