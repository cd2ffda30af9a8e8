"""Problem 10: the subject areas of each document, by class-association rules.

1. Labelled documents (at most ``LABELLED_ROWS``, the only bounded sample here) become transactions: the words and the
   pairs of neighbouring words of a text, without code spans.
2. Parallel frequent-pattern growth: for each subject the frequent items significantly tied to it (chi-square) are ordered
   by frequency and dealt to groups; every transaction is sent to the groups of its items, cut behind the last of them;
   each group grows a prefix tree whose nodes count transactions and those of the subject, and mines the rules (up to
   ``MAX_ITEMS`` items -> subject) ending in its items, by conditional trees. A branch ends where no longer rule can be significantly more
   confident than those of its single items and of the patterns it extends: every rule in it would be redundant.
3. Redundant rules are pruned: a rule stays if it is more confident than every rule for the same subject with a part of
   its items, and significantly so (chi-square within the documents of that rule) for its items and the patterns it was
   grown from.
4. Every document is scored: each match of a rule is evidence for its subject. The evidence and its share among all
   subjects are calibrated to a probability by logistic regression on labelled documents that had no part in mining the
   rules they are scored by (``FOLDS`` folds); a document is about the subjects of a probability of at least one half.
   Evidence of a passing mention has a small share.

Defined results
* null, empty or contentless texts (no evidence) have no subject; texts without labels are scored like all others;
* labels with a null subject, or one that is not in ``subjects``, are ignored, repeated labels count once;
* without any usable label there are no rules and no rows; whole texts are used, of any length;
* repeated rows of a document give one row per subject; a null doc_id is an id like any other; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovework.runtime import cut, ship

LABELLED_ROWS = 20_000
MIN_SUPPORT = 3  # documents, whatever the number of labelled ones
MIN_CONFIDENCE = 0.6
CHI_SQUARE = 10.83  # 0.1 % level, one degree of freedom
MAX_ITEMS = 4  # items of a rule at most
GROUPS = 4  # groups of each subject
FOLDS = 3
LONG_WEIGHT = 0.1  # evidence of a rule of several items beside that of single ones: it settles what they leave open

_CODE = re.compile(r"```.*?```|`[^`]*`", re.S)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[^\w\s'’-]|\n")


def tokens(text: str | None) -> list[str]:
    """Words in lower case and what stands between them and breaks a phrase."""
    return _TOKEN.findall(_CODE.sub(" | ", text or "").lower())


def text_items(text: str | None) -> list[str]:
    """Words and pairs of neighbouring words, in lower case, as often as they occur."""
    found = tokens(text)
    is_word = [x[0].isalpha() for x in found]
    out = [x for x, w in zip(found, is_word) if w]
    out += [f"{a} {b}" for a, b, v, w in zip(found, found[1:], is_word, is_word[1:]) if v and w]
    return out


class Tree:
    """Prefix tree of transactions; a node counts the transactions through it, and those of the subject among them."""

    def __init__(self) -> None:
        self.parent, self.item, self.count, self.hits = [-1], [-1], [0], [0]
        self.child: dict[tuple[int, int], int] = {}
        self.heads: dict[int, list[int]] = {}

    def add(self, items: list[int], n: int, hits: int) -> None:
        at = 0
        for i in items:
            to = self.child.get((at, i))
            if to is None:
                to = self.child[at, i] = len(self.item)
                self.parent.append(at)
                self.item.append(i)
                self.count.append(0)
                self.hits.append(0)
                self.heads.setdefault(i, []).append(to)
            self.count[to] += n
            self.hits[to] += hits
            at = to

    def path(self, node: int) -> list[int]:
        out = []
        node = self.parent[node]
        while node > 0:
            out.append(self.item[node])
            node = self.parent[node]
        return out[::-1]

    def grow(self, item: int, longest: int, least: int, need: list[float] | None = None, tail: tuple = (), grown: tuple = (), floor: float = 0.0) -> Iterator[tuple[tuple, int, int, tuple]]:
        """(items, support, hits, patterns it extends) of the frequent patterns that end in ``item`` + ``tail``.

        With ``need`` (of each item the hits a pattern with it must have, see ``_need``) patterns of fewer hits are left
        out with all that contain them, as are those with fewer hits than the patterns they extend call for. The patterns
        are (support, hits) of those of two items or more.
        """
        nodes = self.heads.get(item, [])
        total, hits = sum(self.count[n] for n in nodes), sum(self.hits[n] for n in nodes)
        here = (item, *tail)
        if need is not None:
            floor = max(floor, need[item])
        if total < least or (tail and hits < floor):
            return
        yield here, total, hits, grown
        if len(here) >= longest:
            return
        if tail:  # of single items only transactions with other ones are here
            grown = (*grown, (total, hits))
            if need is not None:
                floor = max(floor, _need(total, hits))
        if need is not None and hits < floor:
            return
        conditional: dict[int, list[int]] = {}
        paths = [(self.path(n), self.count[n], self.hits[n]) for n in nodes]
        for path, n, k in paths:
            for other in path:
                c = conditional.get(other)
                if c is None:
                    conditional[other] = [n, k]
                else:
                    c[0] += n
                    c[1] += k
        kept = {o: c for o, c in conditional.items() if c[0] >= least and (need is None or (c[1] >= floor and c[1] >= need[o]))}
        if len(here) + 1 == longest or len(kept) < 2:  # no tree is needed below
            for other, (n, k) in kept.items():
                yield (other, *here), n, k, grown
            return
        tree = Tree()
        for path, n, k in paths:
            tree.add([o for o in path if o in kept], n, k)
        for other in list(tree.heads):
            yield from tree.grow(other, longest, least, need, here, grown, floor)


def labelled(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """``doc_id, text, subjects, fold`` of at most ``rows`` labelled documents, chosen by hash."""
    names = subjects.where(F.col("subject").isNotNull()).select("subject").distinct()
    given = labels.where(F.col("doc_id").isNotNull()).join(F.broadcast(names), "subject", "left_semi")
    given = given.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    one = documents.join(chosen.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    return one.join(chosen, "doc_id")


def _transactions(train: DataFrame) -> DataFrame:
    def to_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["doc_id", "fold", "subjects"]].assign(items=pd.Series([list(dict.fromkeys(text_items(t))) for t in pdf["text"]], index=pdf.index, dtype="object"))

    return cut(train.mapInPandas(to_items, "doc_id long, fold int, subjects array<string>, items array<string>"), "transactions")


def numbered(trans: DataFrame, least: int = MIN_SUPPORT) -> tuple[DataFrame, list[str]]:
    """(transactions with the numbers of their frequent items in ascending order, the items by number, the most frequent
    first): what all minings of the same transactions share."""
    freq = trans.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    words = freq.toPandas().sort_values(["n", "item"], ascending=[False, True])["item"].tolist()
    shared = trans.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(words)})

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = shared.value
        for pdf in batches:
            yield pdf.assign(items=pd.Series([sorted(rank[x] for x in items if x in rank) for items in pdf["items"]], index=pdf.index, dtype="object"))

    keep = [c for c in ("doc_id", "fold", "subjects", "items") if c in trans.columns]
    schema = ", ".join("items array<int>" if c == "items" else f"{c} {dict(trans.dtypes)[c]}" for c in keep)
    return cut(trans.select(*keep).mapInPandas(number, schema), "numbered"), words


def _better(n: float, k: float, m: float, j: float) -> float:
    """Chi-square of a part of ``m`` with ``j`` hits against the rest of ``n`` with ``k`` hits (0 if it is not better)."""
    gap = j * n - m * k
    if gap <= 0:
        return 0.0
    below = m * (n - m) * k * (n - k)
    return gap * gap * n / below if below else 0.0


def _need(n: float, k: float) -> float:
    """The hits a part without misses must have to be significantly better than ``k`` of ``n`` (no part is, if all hit)."""
    return CHI_SQUARE * k * n / (n * (n - k) + CHI_SQUARE * k) if k < n else float("inf")


def mine_rules(trans: DataFrame, least: int = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, longest: int = MAX_ITEMS) -> pd.DataFrame:
    """The rules of transactions (subjects, items); see ``mine_numbered``."""
    return mine_numbered(*numbered(trans, least), least, confidence, longest)


def mine_numbered(trans: DataFrame, words: list[str], least: int = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, longest: int = MAX_ITEMS) -> pd.DataFrame:
    """``items`` (tuple), ``subject``, ``support``, ``confidence`` of the rules left after pruning.

    Everything here grows with the labelled sample only, which is bounded.
    """
    spark = trans.sparkSession
    n_docs = trans.count()
    totals = {r["s"]: r["n"] for r in trans.select(F.explode("subjects").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return pd.DataFrame({"items": [], "subject": [], "support": [], "confidence": []})
    # of each item its documents, in all (no subject) and by subject, in one pass
    marks = F.explode(F.concat(F.array(F.lit(None).cast("string")), "subjects")).alias("s")
    counts = trans.select("subjects", F.explode("items").alias("item")).select("item", marks).groupBy("item", "s").agg(F.count(F.lit(1)).alias("k"))
    whole = counts.where("s is null").select("item", F.col("k").alias("n")).where(F.col("n") >= least)
    joint = counts.where("s is not null").join(whole, "item")
    size = F.create_map(*[F.lit(x) for s, t in totals.items() for x in (s, float(t))])[F.col("s")]
    n, k, all_ = F.col("n").cast("double"), F.col("k").cast("double"), F.lit(float(n_docs))
    gap = k * all_ - n * size
    chi = gap * gap * all_ / F.greatest(n * size * (all_ - n) * (all_ - size), F.lit(1e-9))
    tied = ((gap > 0) & ((chi >= CHI_SQUARE) | (k >= all_ * 0.999))).alias("tied")
    hits = F.collect_list(F.struct("s", "k", tied)).alias("hits")
    kept = joint.groupBy("item").agg(F.max("n").alias("n"), F.max(tied).alias("any"), hits).where("any").toPandas().sort_values("item")
    order = np.full(len(words), -1, dtype="int32")
    order[kept["item"]] = np.arange(len(kept))
    words = [words[i] for i in kept["item"]]
    names = sorted(totals)
    place = {s: i for i, s in enumerate(names)}
    support = kept["n"].astype("int64").tolist()
    single = [{place[h["s"]]: int(h["k"]) for h in hs} for hs in kept["hits"]]
    # the subjects for which a rule with the item could be significantly better than the item alone
    open_ = [tuple(place[h["s"]] for h in hs if h["tied"] and least <= h["k"] < n and n >= CHI_SQUARE) for n, hs in zip(support, kept["hits"])]
    shared = spark.sparkContext.broadcast((order, place, support, single, open_))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank, number, _, _, subjects_of = shared.value
        useful = np.array([bool(x) for x in subjects_of] + [False])
        for pdf in batches:
            rows = []
            for items, subjects in zip(pdf["items"], pdf["subjects"]):
                own: dict[int, list[int]] = {}
                t = rank[np.asarray(items, dtype="int64")]
                for i in t[useful[t]].tolist():
                    for s in subjects_of[i]:
                        own.setdefault(s, []).append(i)
                here = {number[x] for x in subjects}
                for s, t in own.items():
                    met = set()
                    for j in range(len(t) - 1, 0, -1):
                        g = t[j] % GROUPS
                        if g not in met:
                            met.add(g)
                            rows.append((s * GROUPS + g, t[: j + 1], s in here))
            yield pd.DataFrame(rows, columns=["grp", "items", "hit"])

    def mine(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, n_of, k_of, _ = shared.value
        tree, own = Tree(), set()
        s, g = divmod(int(pdf["grp"].iloc[0]), GROUPS)
        for items, hit in zip(pdf["items"], pdf["hit"]):
            items = items.tolist()
            tree.add(items, 1, int(hit))
            own.update(i for i in items[1:] if i % GROUPS == g)

        def improves(items: tuple, m: int, j: int, grown: tuple) -> bool:
            return all(_better(n, k, m, j) >= CHI_SQUARE for n, k in grown) and all(_better(n_of[i], k_of[i][s], m, j) >= CHI_SQUARE for i in items)

        need = [max(least, _need(n, k[s])) if s in k else float("inf") for n, k in zip(n_of, k_of)]
        rows = []
        for i in sorted(own):
            for items, m, j, grown in tree.grow(i, longest, least, need):
                if len(items) > 1 and j >= confidence * m and improves(items, m, j, grown):
                    rows.append((sorted(items), s, m, j / m))
        return pd.DataFrame(rows, columns=["items", "subject", "support", "confidence"])

    mined = None
    if longest > 1:
        dealt = trans.mapInPandas(deal, "grp int, items array<int>, hit boolean")
        # a task for each group or so: the work is in the trees, not in the bytes, by which adaptive execution would merge
        dealt = dealt.repartition(len(names) * GROUPS, "grp")
        mined = dealt.groupBy("grp").applyInPandas(mine, "items array<int>, subject int, support long, confidence double").toPandas()
    rules = {((i,), s): (n, c / n) for i, n in enumerate(support) for s, c in single[i].items() if c >= least and c >= confidence * n}
    longer = [] if mined is None else zip(mined["items"], mined["subject"], mined["support"], mined["confidence"])
    for items, s, m, c in sorted(((tuple(map(int, x[0])), int(x[1]), int(x[2]), float(x[3])) for x in longer), key=lambda x: (len(x[0]), x)):
        parts = (p for size in range(1, len(items)) for p in itertools.combinations(items, size))
        if all(rules.get((p, s), (0, -1.0))[1] < c for p in parts):  # shorter rules come first
            rules[items, s] = (m, c)
    keep = [(tuple(words[i] for i in items), names[s], m, c) for (items, s), (m, c) in rules.items()]
    return pd.DataFrame(keep, columns=["items", "subject", "support", "confidence"])


class Scorer:
    """Evidence of matching rules, and its calibration."""

    def __init__(self, rules: pd.DataFrame) -> None:
        self.names = sorted(set(rules["subject"]))
        at = {s: i for i, s in enumerate(self.names)}
        items = sorted({x for its in rules["items"] for x in its})
        number = {x: i for i, x in enumerate(items)}
        self.word: dict[str, int] = {}
        for x in items:
            for w in x.split(" "):
                self.word.setdefault(w, len(self.word))
        self.base = len(self.word) + 1
        self.of_word = np.full(self.base, -1, dtype="int32")
        pairs = {}
        for x, i in number.items():
            parts = [self.word[w] for w in x.split(" ")]
            if len(parts) == 1:
                self.of_word[parts[0]] = i
            else:
                pairs[parts[0] * self.base + parts[1]] = i
        self.pair_keys = np.array(sorted(pairs), dtype="int64")
        self.of_pair = np.array([pairs[x] for x in sorted(pairs)], dtype="int32")
        self.weight = np.zeros((len(items), len(self.names)), dtype="f4")
        self.longer: dict[int, list[tuple[tuple, int, float]]] = {}
        for its, s, n, c in rules.itertuples(index=False):
            # smoothed confidence: a rule seen a few times weighs less
            w = ((c * n + 0.5) / (n + 1.0)) ** 2
            own = [number[x] for x in its]
            if len(own) == 1:
                self.weight[own[0], at[s]] = w
            else:
                self.longer.setdefault(own[-1], []).append((tuple(own), at[s], w * LONG_WEIGHT))
        self.starts = np.zeros(len(items), dtype=bool)
        self.starts[list(self.longer)] = True
        self.beta = np.array([-4.0, 16.0, 0.0])

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The items of rules that a text has, and how often."""
        get = self.word.get
        ids = np.array([get(x, -1) for x in tokens(text)], dtype="int64")
        words = self.of_word[ids[ids >= 0]]
        a, b = ids[:-1], ids[1:]
        keys = (a * self.base + b)[(a >= 0) & (b >= 0)]
        if len(keys) and len(self.pair_keys):
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            words = np.concatenate([words, self.of_pair[at[self.pair_keys[at] == keys]]])
        return np.unique(words[words >= 0], return_counts=True)

    def evidence(self, text: str | None) -> np.ndarray:
        items, n = self.counts(text)
        e = n @ self.weight[items] if len(items) else np.zeros(len(self.names))
        first = items[self.starts[items]] if len(items) else items
        if len(first):
            have = dict(zip(items.tolist(), n.tolist()))
            for i in first.tolist():
                for own, s, w in self.longer[i]:
                    times = min(have.get(x, 0) for x in own)
                    if times:
                        e[s] += w * times
        return e

    @staticmethod
    def features(e: np.ndarray) -> np.ndarray:
        """Rows (1, share, log evidence) for each subject with evidence."""
        return np.column_stack([np.ones(len(e)), np.minimum(e / max(e.sum(), 1e-9), 0.5), np.log1p(e)])

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 40) -> None:
        """Ridge-regularised logistic regression by Newton steps."""
        if len(y) < 30 or y.min() == y.max():
            return
        b = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            grad = x.T @ (p - y) + 0.1 * b
            step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + 0.1 * np.eye(x.shape[1]), grad)
            b -= step
            if np.abs(step).max() < 1e-6:
                break
        self.beta = b

    def subjects(self, text: str | None) -> list[tuple[str, float]]:
        e = self.evidence(text)
        hits = np.flatnonzero(e > 0)
        if not len(hits):
            return []
        p = 1 / (1 + np.exp(-np.clip(self.features(e)[hits] @ self.beta, -30, 30)))
        return [(self.names[i], float(q)) for i, q in zip(hits, p)]


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rows: int = LABELLED_ROWS) -> Scorer:
    ship(documents.sparkSession)
    spark = documents.sparkSession
    sample = cut(labelled(documents, labels, subjects, rows), "labelled")
    trans, words = numbered(_transactions(sample))
    held: dict[int, Scorer] = {f: Scorer(mine_numbered(trans.where(F.col("fold") != f), words)) for f in range(FOLDS)}
    shared = spark.sparkContext.broadcast(held)

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xs, ys = [], []
            for text, fold, subjects_ in zip(pdf["text"], pdf["fold"], pdf["subjects"]):
                s = shared.value[int(fold)]
                e = s.evidence(text)
                hits = np.flatnonzero(e > 0)
                xs += s.features(e)[hits].tolist()
                ys += [float(s.names[i] in set(subjects_)) for i in hits]
            yield pd.DataFrame({"x": pd.Series(xs, dtype="object"), "y": pd.Series(ys, dtype="f8")})

    got = sample.mapInPandas(examples, "x array<double>, y double").toPandas()  # of the bounded sample
    scorer = Scorer(mine_numbered(trans, words))
    if len(got):
        scorer.fit(np.array(got["x"].tolist()), got["y"].to_numpy())
    return scorer


def assign(documents: DataFrame, scorer: Scorer, least: float = 0.5) -> DataFrame:
    """``doc_id, subject, probability`` of every subject a document is about."""
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for pdf in batches:
            rows = [(i, name, p) for i, t in zip(pdf["doc_id"], pdf["text"]) for name, p in s.subjects(t) if p >= least]
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "probability"])

    return documents.select("doc_id", "text").mapInPandas(score, "doc_id long, subject string, probability double")


def found(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    return assign(documents, train(documents, labels, subjects)).select("doc_id", "subject").distinct()


def composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """The make-up of the corpus: documents and characters of each subject (a document of n subjects counts 1/n for each)."""
    about = assign(documents, train(documents, labels, subjects)).dropDuplicates(["doc_id", "subject"])
    sizes = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).dropDuplicates(["doc_id"])
    spread = about.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    every = sizes.join(spread, "doc_id", "left").select(
        "chars", F.coalesce("subjects", F.array(F.lit("(none)"))).alias("subjects")
    )
    share = every.select(F.explode("subjects").alias("subject"), (F.lit(1.0) / F.size("subjects")).alias("w"), "chars")
    return share.groupBy("subject").agg(
        F.count(F.lit(1)).alias("documents"), F.round(F.sum("w"), 3).alias("weight"), F.round(F.sum(F.col("w") * F.col("chars")), 1).alias("chars")
    )
