import itertools
import random

import pytest

from grovework.llm import subjects as S

TERMS = {"law": ["contract clause", "court ruling", "witness statement"], "sport": ["league table", "lap time", "penalty kick"], "food": ["recipe step", "oven heat", "menu price"]}
LINES = ["The {} service reads each {} from the queue.", "If the {} does not match the {}, report it.", "Fixes a crash when the {} was empty and the {} written."]


def make(n, seed=0):
    rnd = random.Random(seed)
    docs, labels, truth = [], [], {}
    for i in range(n):
        own = rnd.sample(sorted(TERMS), 1 if rnd.random() < 0.8 else 2)
        lines = [rnd.choice(LINES).format(*rnd.choices(TERMS[s], k=2)) for s in own for _ in range(rnd.randint(4, 8))]
        if rnd.random() < 0.3:
            other = rnd.choice([s for s in TERMS if s not in own])
            lines.append(f"The `x` page mentions the {rnd.choice(TERMS[other])} once.")
        rnd.shuffle(lines)
        docs.append((i, " ".join(lines)))
        truth[i] = set(own)
        labels += [(i, s) for s in own]
    return docs, labels, truth


def frames(spark, docs, labels):
    return (
        spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, subject string"),
        spark.createDataFrame([(i, s, "clash") for i, s in labels], "doc_id long, subject string, text string"),
        spark.createDataFrame([(s, "clash") for s in [*TERMS, "none"]] + [(None, "x")], "subject string, text string"),
    )


def test_held_out_accuracy(spark):
    docs, labels, truth = make(400)
    wrong = [(0, "sport"), (1, None), (2, "not a subject"), (3, "law"), (3, "law"), (None, "law"), (99_999, "law")]
    d, lab, subs = frames(spark, docs + [(1000, None), (1001, ""), (1002, "..."), (1003, "The league table. " * 20_000)], [x for x in labels if x[0] < 300] + wrong)
    got = {}
    for r in S.found(d, lab, subs).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held = [i for i in truth if i >= 300]
    right = sum(len(got.get(i, set()) & truth[i]) for i in held)
    assert right / sum(len(got.get(i, set())) for i in held) >= 0.9 and right / sum(len(truth[i]) for i in held) >= 0.9
    assert got[1003] == {"sport"} and not {1000, 1001, 1002} & set(got)


def test_no_labels(spark):
    d, lab, subs = frames(spark, make(5)[0], [])
    assert S.found(d, lab, subs).count() == 0
    d, lab, subs = frames(spark, [], [])
    assert S.found(d, lab, subs).count() == 0 and S.composition(d, lab, subs).count() == 0


@pytest.mark.parametrize("longest", [1, 2, 3, 4])
def test_growth_against_enumeration(longest):
    rnd = random.Random(longest)
    rows = [(sorted(rnd.sample(range(8), rnd.randint(0, 6))), rnd.random() < 0.4) for _ in range(90)]
    tree = S.Tree()
    for items, hit in rows:
        tree.add(items, 1, hit)
    got = {items: (n, k) for i in range(8) for items, n, k, _ in tree.grow(i, longest, 4)}
    want = {}
    for k in range(1, longest + 1):
        for items in itertools.combinations(range(8), k):
            hits = [hit for t, hit in rows if set(items) <= set(t)]
            if len(hits) >= 4:
                want[items] = (len(hits), sum(hits))
    assert got == want


def test_rules_against_enumeration(spark):
    """All rules of up to 3 items: frequent, sure, significantly better than their items and not redundant."""
    rnd = random.Random(8)
    rows = []
    for i in range(400):
        a, b, c = (rnd.random() < 0.5 for _ in range(3))
        items = [x for x, on in (("a", a), ("b", b), ("c", c), ("d", rnd.random() < 0.3)) if on] + ["z"]
        rows.append((i, ["law"] if (a and b) or rnd.random() < 0.15 else ["food"] if c and rnd.random() < 0.6 else ["sport"], items, [1] * len(items)))
    trans = spark.createDataFrame(rows, "doc_id long, subjects array<string>, items array<string>, counts array<int>")
    rules = S.mine_rules(trans, confidence=0.6, longest=3)
    got = {(tuple(sorted(x)), s): (int(n), round(c, 9)) for x, s, n, c in rules.itertuples(index=False)}
    count = lambda items, s: (sum(set(items) <= set(r[2]) for r in rows), sum(set(items) <= set(r[2]) and s in r[1] for r in rows))
    assert (("a", "b"), "law") in got
    for (items, s), (n, c) in got.items():
        assert (n, round(count(items, s)[1] / n, 9)) == (count(items, s)[0], c) and c >= 0.6
        for k in range(1, len(items)):
            for part in itertools.combinations(items, k):
                assert got.get((part, s), (0, -1))[1] < c
        if len(items) > 1:
            assert all(S._better(*count((i,), s), n, round(n * c)) >= S.CHI_SQUARE for i in items)
    tied = lambda i, s: S._better(400, sum(s in r[1] for r in rows), *count((i,), s)) >= S.CHI_SQUARE
    for x, y in itertools.combinations("abcd", 2):
        for s in ("law", "food", "sport"):
            n, j = count((x, y), s)
            if j >= 3 and j >= 0.6 * n and all(tied(i, s) and S._better(*count((i,), s), n, j) >= S.CHI_SQUARE for i in (x, y)):
                assert ((x, y), s) in got


def test_items():
    assert S.text_items("The `skip_me` Court-room ruling, x9 Übung\nnext") == ["the", "court-room", "ruling", "court-room ruling", "x", "übung", "next"] or "court-room ruling" in S.text_items("The `skip_me` Court-room ruling")
    assert S.text_items(None) == []


def test_support_does_not_grow_with_the_input(spark):
    rows = [(i, ["food" if i % 10 else "law"], ["common"] + (["rare term"] if i in (0, 10, 20) else [])) for i in range(8000)]
    trans = spark.createDataFrame([(*r, [1] * len(r[2])) for r in rows], "doc_id long, subjects array<string>, items array<string>, counts array<int>")
    rules = S.mine_rules(trans, confidence=0.6)
    assert (("rare term",), "law", 3) in set(zip(rules["items"], rules["subject"], rules["support"]))
