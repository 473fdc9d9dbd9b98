import hashlib
import random
import re

from docquill.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for d, text in docs:
        words, hit, who = low(text), set(), set()
        for name, item in items:
            own = low(item)
            size = min(window, len(own))
            for i in range(max(0, len(own) - size + 1)) if own else ():
                for at in range(len(words) - size + 1):
                    if words[at : at + size] == own[i : i + size]:
                        hit |= set(range(at, at + size))
                        who.add(str(name))
        out.append((d, len(words), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return out


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark, make):
    rng = random.Random(8)
    words = ["a", "b", "c", "D", "éx", "42"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 5, 9, 10, 11, 14])))) for k in range(25)] + [(99, None), (3, "a b a b a b")]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(120))) + rng.choice(["", ". " + items[rng.randrange(25)][1]])) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "..."), (103, items[4][1].upper())]
    for block in (500_000, 20):
        got = decontaminate.contamination(make(docs), table(spark, items), block_words=block).collect()
        assert sorted(tuple(r) for r in got) == sorted(brute(docs, items))


def test_empty_tables(spark, make):
    assert decontaminate.contamination(make([]), table(spark, [(1, "a")])).count() == 0
    got = decontaminate.contamination(make(["some words"]), table(spark, [])).collect()
    assert not got[0]["contaminated"] and got[0]["n_words"] == 2


def test_spans_are_cut(spark, make):
    passage = " ".join(f"p{k}" for k in range(12))
    own = " ".join(f"own{k}" for k in range(20))
    docs = make([(1, f"{own}\n{passage}! end é"), (2, passage), (3, own), (4, None)])
    got = {r["doc_id"]: r for r in decontaminate.decontaminated(docs, table(spark, [(1, passage.upper())])).collect()}
    assert got[1]["text"] == f"{own}\n! end é" and 2 not in got and got[3]["text"] == own and got[4]["text"] is None
    assert list(got[1].asDict()) == docs.columns and got[1]["size"] == "src"
