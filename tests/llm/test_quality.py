import math
import re

import numpy as np
from pyspark.sql import functions as F

from docquill.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(make, corpus):
    texts = corpus[:100] + [(9000, None), (9001, ""), (9002, " \n\x0b "), (9003, "a b a b a b a b"), (9004, "é\xa0x  y"), (9005, "a\na\n\n \na\nb"), (9006, "w x y\nw x y"), (9007, "same " * 20_000), (9008, "a b")]
    got = {r["doc_id"]: tuple(r[c] for c in quality.STATS) for r in quality.statistics(make(texts)).collect()}
    assert got == {d: brute(t) for d, t in texts}


def test_verdicts(make):
    import random

    rng = random.Random(1)
    words = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(80, 800)))) for k in range(300)]
    rows += [(1000 + k, " ".join(rng.choice(words) + " ###" for _ in range(100))) for k in range(5)] + [(2000, "few words"), (2001, None), (2002, "over and over again " * 50), (0, rows[0][1])]
    got = {r["doc_id"]: r for r in quality.judged(make(rows)).collect()}
    assert len(got) == len(rows) - 1 and all(got[k]["kept"] for k in range(300))
    assert not any(got[1000 + k]["kept"] or got[1000 + k]["base_failed"] for k in range(5))
    assert all(got[k]["base_failed"] and not got[k]["kept"] for k in (2000, 2001, 2002))
    assert quality.judged(make([])).count() == 0


def test_distances_are_those_of_the_estimate(spark):
    """The whitener of a covariance gives the Mahalanobis distance."""
    rng = np.random.default_rng(0)
    a = rng.standard_normal((5, 5))
    cov, mean, x = a @ a.T + np.eye(5), rng.standard_normal(5), rng.standard_normal(5)
    row = [("a", "b", mean.tolist(), [float(cov[i, j]) for i, j in quality.PAIRS])]
    white = spark.createDataFrame(row, "glang string, gsource string, m array<double>, c array<double>").withColumn("w", quality.whitener(F.col("c")))
    point = spark.createDataFrame([("a", "b", *map(float, x))], "glang string, gsource string, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    got = point.join(white, quality.GROUP).select(quality.distance()).first()[0]
    assert np.isclose(got, (x - mean) @ np.linalg.inv(cov) @ (x - mean))


def test_boilerplate_below_the_base_limit_is_an_outlier(make):
    import random

    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, "\n".join(line(12) for _ in range(rng.randint(12, 40)))) for k in range(300)]
    rows += [(500 + k, "\n".join([*own, own[0], "a # b"])) for k in range(10) for own in [[line(12) for _ in range(25)]]]  # one line again, one symbol
    for k in range(5):
        own, short = [line(12) for _ in range(18)], [line(2) for _ in range(4)]
        rows.append((1000 + k, "\n".join(own + short * 4)))  # 35 % of the lines are repeated
        passage = line(40)
        rows.append((2000 + k, "\n".join([*own[:8], f"{passage} {line(3)}", f"{line(3)} {passage}"])))  # 45 % of the words lie in repeats
        rows.append((3000 + k, "\n".join(x + " ##" for x in own)))
    got = {r["doc_id"]: r for r in quality.judged(make(rows)).collect()}
    odd = [base + k for base in (1000, 2000, 3000) for k in range(5)]
    assert not any(got[d]["base_failed"] for d in odd) and not [d for d in odd if got[d]["kept"]]
    assert sum(got[d]["kept"] for d in range(300)) >= 297 and all(got[500 + k]["kept"] for k in range(10))


def whole(x, q):
    """What percentile_approx gives of few values: one of them."""
    return np.sort(x, axis=0)[max(0, math.ceil(q * len(x)) - 1)]


def moments(x):
    c = x.T @ x / len(x) - np.outer(x.mean(0), x.mean(0))
    return x.mean(0), floored(c)


def floored(c, floor=np.array(quality.FLOOR)):
    c = c.copy()
    np.fill_diagonal(c, np.maximum(np.diag(c), floor**2))
    return c


def far(x, m, c):
    """Squared distances by Cholesky, a pivot being 1e-9 at least."""
    low = np.zeros_like(c)
    for i in range(len(c)):
        for j in range(i + 1):
            rest = c[i, j] - low[i, :j] @ low[j, :j]
            low[i, j] = math.sqrt(max(rest, 1e-9)) if i == j else rest / low[j, j]
    return ((np.linalg.inv(low) @ (x - m).T) ** 2).sum(0), np.log(np.diag(low)).sum()


def concentrated(x):
    m = whole(x, 0.5)
    scale = np.maximum(whole(np.abs(x - m), 0.5) * 1.4826, quality.FLOOR)
    z = (x - m) / scale
    found = []
    for c in (np.eye(5), np.tanh(z), z / np.maximum(1e-9, np.sqrt((z * z).sum(1)))[:, None]):
        c = c if c is not z and c.shape == (5, 5) and (c == np.eye(5)).all() else floored(c.T @ c / len(c) - np.outer(c.mean(0), c.mean(0)), np.full(5, 0.03))
        d = far(z, np.zeros(5), c)[0]
        for _ in range(quality.STEPS + 1):
            own = moments(x[d <= whole(d, quality.HALF)])
            d, size = far(x, *own)
        found.append((size, *own))
    return found


def leaning(n, m, c, pm, pc):
    k = quality.PRIOR
    mean = (n * m + k * pm) / (n + k)
    return mean, floored((n * (c + np.outer(m, m)) + k * (pc + np.outer(pm, pm))) / (n + k) - np.outer(mean, mean))


def pooled(parts):
    n = sum(p[0] for p in parts)
    m = sum(p[0] * p[1] for p in parts) / n
    return n, m, floored(sum(p[0] * (p[2] + np.outer(p[1], p[1])) for p in parts) / n - np.outer(m, m))


def scaled(n, d):
    return max(1.0, (n * whole(d, 0.5) / quality.MEDIAN + quality.PRIOR) / (n + quality.PRIOR))


def test_estimates_against_brute_force(spark, make):
    """Groups of three hundred rows, of a few, of one, with null and empty names."""
    rng = np.random.default_rng(3)
    groups = {("=en", "=a"): 300, ("=en", "=b"): 40, ("=en", ""): 7, ("=en", "="): 3, ("=de", "=a"): 120, ("", "=a"): 1}
    data = {}
    for g, n in groups.items():
        x = rng.standard_normal((n, 5)) @ rng.standard_normal((5, 5)) + rng.standard_normal(5) * 3
        x[: n // 8] += 15
        data[g] = x
    rows = spark.createDataFrame([(*g, *map(float, r)) for g, x in data.items() for r in x], "glang string, gsource string, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    got = {(r["glang"], r["gsource"]): r for r in quality.estimated(rows).collect()}
    best = {g: (len(x), *min(concentrated(x), key=lambda e: e[0])[1:]) for g, x in data.items()}
    langs = {lang: pooled([b for g, b in best.items() if g[0] == lang]) for lang in {g[0] for g in groups}}
    _, pm, pc = pooled(list(langs.values()))
    for g, x in data.items():
        above = leaning(*langs[g[0]], pm, pc)
        m, c = leaning(*best[g], *above)
        for _ in range(quality.REWEIGHTS):
            d = far(x, m, c)[0]
            own = x[d <= scaled(len(x), d) * quality.NEAR]
            m, c = leaning(len(own), *(moments(own) if len(own) else above), *above)
        d = far(x, m, c)[0]
        assert np.allclose(got[g]["m"], m, rtol=1e-6, atol=1e-8) and np.isclose(got[g]["factor"], scaled(len(x), d), rtol=1e-6)
        low = np.zeros((5, 5))
        for k, (i, j) in enumerate(quality.PAIRS):
            low[i, j] = got[g]["w"][k]
        assert np.allclose(((low @ (x - m).T) ** 2).sum(0), d, rtol=1e-5)


def test_the_least_determinant_is_near_that_of_many_random_starts():
    rng = np.random.default_rng(8)
    for _ in range(4):
        x = rng.standard_normal((240, 5)) @ rng.standard_normal((5, 5))
        x[:45] = rng.standard_normal((45, 5)) * 0.3 + 9
        sizes = []
        for _ in range(150):
            own = moments(x[rng.choice(len(x), 6, replace=False)])
            for _ in range(12):
                d, size = far(x, *own)
                own = moments(x[d <= whole(d, quality.HALF)])
            sizes.append(far(x, *own)[1])
        assert min(c[0] for c in concentrated(x)) <= min(sizes) + 0.05


def test_many_groups_are_joined_by_salt(make, monkeypatch):
    rows = [(k, f"word{k} " * 3 + " ".join(f"x{k}y{i}" for i in range(80))) for k in range(40)]
    one = sorted(tuple(r) for r in quality.judged(make(rows)).collect())
    monkeypatch.setattr(quality, "BROADCAST", 0)
    assert sorted(tuple(r) for r in quality.judged(make(rows)).collect()) == one
