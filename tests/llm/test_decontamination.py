import random
import re

from tintwerk.llm import decontamination as dc


def least_distance(item, text):
    """Sellers' dynamic programme."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_equals_the_dynamic_programme():
    r = random.Random(2)
    for _ in range(300):
        item, text = ("".join(r.choice("abc ") for _ in range(r.randrange(1, n))) for n in (90, 150))
        distance, end = dc.Pattern(item).best(text)
        assert distance == least_distance(item, text) and distance == min([len(item), *(least_distance(item, text[:end]),)])


def edited(r, text, edits):
    for _ in range(edits):
        at = r.randrange(len(text))
        text = text[:at] + r.choice(["", "x", text[at] + "y"]) + text[at + 1 :]
    return text


def test_matches_equal_brute_force(spark):
    r = random.Random(9)
    words = ["".join(r.choice("aeinrstüé") for _ in range(r.randrange(1, 8))) for _ in range(60)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(r.randrange(12, 30)).capitalize()) for i in range(12)] + [(90, None), (91, "kurz"), (92, ""), (93, None), (95, "Was ist 2+2?"), (96, " \n")]
    items.append((94, items[0][1]))
    docs = [(0, None), (1, ""), (2, say(40)), (100, "zu kurz."), (101, "kurzer kurz1 verkurz"), (102, "Frage: was  ist 2+2? Vier."), (103, "was ist 2+2?"), (104, "etwas ist 2+2?")]
    for d in range(3, 80):
        i, text = items[r.randrange(12)]
        docs.append((d, say(r.randrange(30)) + r.choice([" ", "\n", "  "]) + edited(r, text.upper() if d % 3 else text, r.randrange(0, 14)) + " " + say(r.randrange(30))))
    docs.append((2, docs[10][1]))
    want = set()
    for d, t in docs:
        for i, x in items:
            n = dc.normalised(x or "")
            if not t or not n:
                continue
            if len(n) < dc.LEAST:
                if re.search(r"(?<![^\W_])" + re.escape(n) + r"(?![^\W_])", dc.normalised(t)):
                    want.add((d, i, 0))
            elif (e := least_distance(n, dc.normalised(t))) <= dc.budget(len(n)):
                want.add((d, i, e))
    schema = "doc_id long, text string, item_id string, end int"
    table = spark.createDataFrame([(*d, "x", None) for d in docs], schema)
    found = dc.matches(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id, x.distance) for x in found} == want and len(want) > 20
    dirty = {w[0] for w in want}
    kept = dc.cleaned(table, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == table.columns and {x.doc_id for x in kept.collect()} == {d for d, t in docs if d not in dirty} | {2}
    assert dc.matches(table, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert dc.matches(spark.createDataFrame([], schema), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_long_text(spark):
    item = "eine längere frage nach dem sinn des lebens und allem anderen?"
    docs = [(1, "lang " * 300_000 + item.replace("sinn", "sin") + " lang" * 300_000), (2, "lang " * 300_000)]
    found = dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(x.doc_id, x.item_id, x.distance) for x in found] == [(1, 7, 1)]
