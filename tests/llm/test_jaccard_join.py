import random

import pytest

from voxelgrove.llm import jaccard_join as J


def brute(rows):
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(seed, groups, size, rate):
    """Groups of copies of a text with a share of the words changed, near the threshold; a passage that many others hold."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(size):
            w = [word() if rng.random() < rng.choice([0, rate, 2 * rate]) else x for x in base]
            out.append(" ".join(w))
    out += [" ".join([word() for _ in range(rng.randint(0, 12))] + passage + [word() for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    out += [out[0].upper(), out[0], "", "  "]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("block", [J.BLOCK, 8])
def test_same_groups_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = corpus(3, 12, 25, 0.03)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_threshold_is_met_exactly(spark):
    # Sets of 7 and 7 with 6 in common: 6/8 is 0.75; of 6 and 6 with 5 in common: 5/7 is less.
    rows = [(1, "a b c d e f g h i j k"), (2, "b c d e f g h i j k l"), (3, "q b c d e f g h i j"), (4, "b c d e f g h i j r")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
