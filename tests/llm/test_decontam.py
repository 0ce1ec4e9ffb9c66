import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from headlight.llm import common, decontam
from tests.llm import fixtures

ITEMS = [
    (1, "A train leaves Boston at 9 hours and travels 120 km while Anna waits for 30 minutes, then Anna walks 5 km to Boston again."),
    (2, "short item"), (3, None), (4, ""), (5, "the quick brown fox jumps over the lazy dog and then sleeps all day long under trees"),
    (6, "the quick brown fox jumps over the lazy dog and then sleeps all day long under trees"), (None, "null item words here"),
]
NEW = "A train leaves Paris at 7 hours and travels 80 miles while Zoe waits for 45 minutes, then Zoe walks 3 miles to Paris again."
ODD = NEW.replace("then Zoe", "then Ivo")
DOCS = [
    (10, "Noise before it. " + ITEMS[0][1] + " noise"), (11, "And yes " + NEW), (12, "and yes " + ODD), (13, "nothing of the kind"), (14, None), (15, ""),
    (16, "x short item y"), (17, "x shorter item y"), (18, "THE QUICK brown-fox jumps over; the lazy dog\nand then sleeps all day long under trees!"),
    (19, "the quick brown fox jumps over the lazy dog and then slept"), (None, "null item words here " * 2), (20, "y " * 9000 + ITEMS[4][1]), (20, ITEMS[4][1]),
]


def letter(c, kinds):
    return unicodedata.category(c).startswith(kinds)


def brute_words(text):
    text = (text or "").replace("\x02", " ")
    out = []
    for m in re.finditer(r"[^\W_]+(?:(?<=\d)[.,](?=\d)[^\W_]+)*|_+", text):
        w = m[0]
        before = text[: m.start()].rstrip(" ")
        name = len(w) > 1 and letter(w[0], "Lu") and letter(w[1], "Ll") and m.start() > len(before) > 0 and (letter(before[-1], "L") or before[-1] in ",;")
        kind = "<n>" if w[0] in "0123456789" or (not name and w.lower() in decontam.NUMBERS) else "<p>" if name else "<u>" if w.lower() in decontam.UNITS else None
        out.append((kind or w.lower(), kind, w.lower()))
    return out


def brute_item(text):
    """(words, list of (item_pos, words or templates, slots, strict))."""
    w = brute_words(text)
    n = min(8, len(w))
    out = []
    for p in range(len(w) - n + 1) if n else ():
        forms = [[x[0] for x in w[p : p + n]]]
        if p == 0 and re.match(r"[\W_]*[^\W\d_]{2}", text) and letter(text.lstrip(" \n")[0], "Lu") and letter(text.lstrip(" \n")[1], "Ll") and not w[0][1]:
            forms.append(["<p>", *forms[0][1:]])
        for form in forms:
            slots = sum(x in ("<n>", "<p>", "<u>") for x in form)
            strict = slots > 0 and n - slots < 4
            out.append((p, [x[2] for x in w[p : p + n]] if strict else form, 0 if strict else slots, strict))
    return w, n, out


def brute(docs, items):
    best = {}
    for i, item in items:
        b, n, windows = brute_item(item or "")
        of = len({x[0] for x in windows})
        for d, text in docs:
            w = brute_words(text)
            plain, slotted = set(), {}
            for at in range(len(w) - n + 1) if n else ():
                for p, form, slots, strict in windows:
                    if form == [x[2 if strict else 0] for x in w[at : at + n]]:
                        if slots:
                            slotted.setdefault(at, set()).add(p)
                        else:
                            plain.add(p)
            size = Counter(at - p for at, ps in slotted.items() for p in ps)
            chains, last = [], None
            for at in sorted(slotted):
                p = min(slotted[at], key=lambda p: (-size[at - p], at - p))
                if last is None or last >= p:
                    chains.append([])
                chains[-1].append((at, p))
                last = p
            top = (0, 0, 0)
            for chain in chains:
                spots = {(p + k, at + k) for at, p in chain for k in range(n) if b[p + k][1]}
                values, names = {}, {}
                for x, y in spots:
                    values.setdefault((b[x][1], b[x][2]), set()).add(w[y][2])
                    if b[x][1] == "<p>":
                        names.setdefault(w[y][2], set()).add(b[x][2])
                if all(len(v) == 1 for v in [*values.values(), *names.values()]):
                    changed = {x for x, y in spots if b[x][2] != w[y][2]}
                    top = max(top, (len({p for _, p in chain}), len({x for x, _ in spots}), -len(changed)))
            found = len(plain) + top[0]
            if of and 2 * found >= of and found:
                best[d, i] = max(best.get((d, i), (0,)), (found, of, top[1], -top[2]))
    return sorted(str((d, i, x[0], "reparameterised" if x[3] else "verbatim")) for (d, i), x in best.items())


def test_against_brute_force(spark, monkeypatch):
    docs = fixtures.clashing(spark.createDataFrame(DOCS, "doc_id long, text string")).repartition(3)
    bench = fixtures.clashing(spark.createDataFrame(ITEMS, "item_id long, text string"))
    for limit in (0, common.BROADCAST_ROWS):
        monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
        got = decontam.find(docs, bench).collect()
        assert sorted(str((r["doc_id"], r["item_id"], r["found"], r["kind"])) for r in got) == brute(DOCS, ITEMS)
        assert {(10, "verbatim"), (11, "reparameterised")} <= {(r["doc_id"], r["kind"]) for r in got} and not {12, 13, 17, 19} & {r["doc_id"] for r in got}
        kept = decontam.accept(docs, bench)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [12, 13, 14, 15, 17, 19]


def test_tables_and_empty(spark):
    docs, bench = fixtures.docs(spark), spark.read.parquet(f"{fixtures.SF}/benchmark.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect() if r["text"] is None or len(r["text"]) < 20_000]
    small = docs.where(F.col("text").isNull() | (F.length("text") < 20_000))
    got = decontam.find(small, bench).collect()
    held = [r for r in got]
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    whole = {(d, i) for d, t in texts.items() for i, b in items.items() if " ".join(x[0] for x in brute_words(b)[2:]) in " ".join(x[0] for x in brute_words(t))}
    assert whole <= {(r["doc_id"], r["item_id"]) for r in held} and len(rows) > 100
    for a, b in ((fixtures.empty(docs), bench), (docs, fixtures.empty(bench))):
        assert decontam.find(a, b).count() == 0


LONG = ITEMS[0][1]
HARD = [
    (1, LONG.replace("120 km while Anna", "120 km slowly while Zoe").replace("then Anna", "then Ivo")), (2, LONG.replace("120 km", "120 km very slowly")), (3, "He has 43 of them."),
    (4, "So 42 it is"), (5, "run 12 km"), (6, "run 5 km now"), (7, LONG.replace("9 hours", "seven hours").replace("5 km", "three km")), (8, LONG.replace("Anna", "Boston")),
    (9, NEW + " " + LONG), (10, "he said The cat sat on a mat with us"), (11, "x"), (11, "y " + LONG), (11, LONG[: len(LONG) // 2]), (12, "forty two"),
]
SHORT = [*ITEMS, (21, "42"), (22, "5 km"), (23, "The cat sat on a mat with us")]


def test_hard_cases_with_and_without_anchors(spark, monkeypatch):
    """Short items, inserted words, number words, clashing names, rows that share an id; anchors only save work."""
    docs, bench = spark.createDataFrame(HARD, "doc_id long, text string").repartition(3), spark.createDataFrame(SHORT, "item_id long, text string")
    for most in (20_000, 0):
        monkeypatch.setattr(decontam, "MOST_ANCHORS", most)
        got = decontam.find(docs, bench).collect()
        assert sorted(str((r["doc_id"], r["item_id"], r["found"], r["kind"])) for r in got) == brute(HARD, SHORT)
        pairs = {(r["doc_id"], r["item_id"]): r["kind"] for r in got}
        assert not {(1, 1), (3, 21), (5, 22), (8, 1), (12, 21)} & set(pairs)
        assert {(2, 1), (4, 21), (6, 22), (7, 1), (9, 1), (10, 23), (11, 1)} <= set(pairs) and pairs[7, 1] == "reparameterised" and pairs[9, 1] == "verbatim"


def test_plan_is_native(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    items = decontam._items(bench)
    windows = decontam._item_windows(items, 8)
    found = decontam.matches(docs, items, windows)
    frames = [items, windows, decontam._chains(found), decontam._best_chains(docs, items, found.where("slots > 0")), decontam.find(docs, bench)]
    plan = "".join(x._jdf.queryExecution().toString() for x in frames)
    assert found.count() and "Python" not in plan and "Arrow" not in plan
