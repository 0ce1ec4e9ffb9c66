import random
import re
from fractions import Fraction

from headlight.llm import jaccard
from tests.llm import fixtures


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, j in {(i, j) for x in by.values() for a, i in enumerate(x) for j in x[a + 1 :]}:
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            root[top(j)] = top(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(str((d, len(s), least.get(top(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def made(seed):
    """Near copies at all distances, chains, shared lines, short texts."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 3000)
    line = " ".join(word() for _ in range(12))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 8, 12, 30, 80, 200]))]
        for _ in range(rng.randint(1, 14)):
            x = list(base)
            for _ in range(rng.randint(0, max(1, len(x) // 14))):
                x[rng.randrange(len(x))] = word()
            if rng.random() < 0.3:
                x = x[rng.randint(0, len(x) // 5) :] or x
            if rng.random() < 0.4:
                base = x
            texts.append((" ".join(x)).upper() if rng.random() < 0.1 else "\t".join(x))
    texts += [f"{line} {' '.join(word() for _ in range(n))}" for n in (0, 1, 1, 1, 2, 3, 4, 5, 8) for _ in range(4)]
    texts += ["a b c d", "a b c d e", "A B C D", "a a a a a a a a", "a a a a a", None, "", " \n"]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def test_against_brute_force(spark, monkeypatch):
    for seed, hot in ((1, 64), (2, 3)):
        monkeypatch.setattr(jaccard, "HOT_LEAST", hot)
        rows = [*made(seed), (None, "x y z"), (None, "a b c d"), (2, "x Y z"), (2, "x Y z")]
        docs = fixtures.clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
        got = sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in jaccard.join(docs).collect())
        assert got == brute(rows)


def test_documents_and_empty(spark):
    docs = fixtures.docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in jaccard.join(docs).collect())
    assert got == brute(rows)
    assert jaccard.join(fixtures.empty(docs)).count() == 0


def test_prefix_bounds():
    t = Fraction(3, 4)
    for n in range(1, 200):
        for m in range(n, 300):
            need = -(-3 * (n + m) // 7)
            if 4 * n >= 3 * m:
                assert need >= -(-3 * m // 4) and need >= -(-6 * n // 7) and need <= n
    assert t.numerator == 3


def blocks(n, seed=3):
    """Pages of six of the same twelve 40-word paragraphs each, in any order, some of them twice with a word changed."""
    rng = random.Random(seed)
    paragraphs = [" ".join(f"p{i}w{j}" for j in range(40)) for i in range(12)]
    rows = [(i, " ".join(rng.sample(paragraphs, 6))) for i in range(n)]
    return [*rows, *((n + i, t.replace("w7 ", "x ", 1)) for i, t in rows[: n // 20])]


def test_pages_of_shared_blocks_are_not_all_verified(spark, monkeypatch):
    verified, verify = [], jaccard.verify

    def count(pairs, segments, marks, t):
        mark = lambda x: marks.select(jaccard.F.col("sig").alias(x), jaccard.F.col("s").alias(f"s{x}"), jaccard.F.col("o").alias(f"o{x}"))
        verified.append(pairs.join(mark("a"), "a").join(mark("b"), "b").where(jaccard._may_link(t, "a", "b")).count())
        return verify(pairs, segments, marks, t)

    monkeypatch.setattr(jaccard, "verify", count)
    monkeypatch.setattr(jaccard, "FEW", 100)
    for n in (200, 400):
        verified.clear()
        rows = blocks(n)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in jaccard.join(docs).collect())
        assert got == brute(rows)
        print(n, verified)
        assert verified[-1] <= n and sum(verified) <= 40 * n


def test_parities_never_turn_down_a_link(spark):
    """The filter's bound against exact overlaps of random sets."""
    import numpy as np

    rng = np.random.default_rng(4)
    t, rows, links = Fraction(3, 4), [], []
    for i in range(400):
        n = int(rng.choice([5, 60, 400, 3000]))
        a = rng.integers(0, 2**64, n, np.uint64)
        b = np.concatenate([a[int(rng.integers(0, n // 3 + 1)) :], rng.integers(0, 2**64, int(rng.integers(0, n // 4 + 1)), np.uint64)])
        odd = [[int(x) for x in jaccard._parities(x)] for x in (a, b)]
        rows.append((i, len(a), len(b), len(a), len(b), *odd))
        common = len(np.intersect1d(a, b))
        links.append(4 * common >= 3 * (len(a) + len(b) - common))
    df = spark.createDataFrame(rows, "i int, na long, nb long, sa long, sb long, oa array<long>, ob array<long>")
    passed = {r["i"] for r in df.where(jaccard._may_link(t, "a", "b")).select("i").collect()}
    assert {i for i, x in enumerate(links) if x} <= passed and 50 < sum(links) and len(passed) < 400
