import numpy as np
import pytest

from docquill.llm import bpe, decontaminate, langid, secrets, simhash
from docquill.llm.common import table
from tests.llm.conftest import SF
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_simhash import brute as brute_groups
from tests.llm.test_simhash import jaccard_kept

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_run_against_its_stages_by_brute_force(spark):
    docs = table(spark, SF, "documents")
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = langid.fitted(docs)
    names = list(rows)
    p = model.pooled([(rows[d]["text"] or "").encode() for d in names])
    left = [(d, rows[d]["text"]) for d, q in zip(names, p, strict=True) if any(map(str.isalpha, rows[d]["text"] or "")) and q.max() >= corpus_pipeline.LANG_SCORE]
    keep = {d for d, _, c in brute_groups(left) if d == c}
    left = [(d, t) for d, t in left if d in keep]
    share = {d: hit / max(1, n) for d, n, hit, *_ in brute_hits(left, items)}
    left = {d: t for d, t in left if share[d] <= 0.5}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(left) and all(r["same"] for r in got)
    ranks, pattern = bpe.load_ranks(bpe.vocabulary()[0]), bpe.vocabulary()[1]
    coder, clean = bpe.Encoder(ranks, pattern), 0
    base = [secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.RUN]
    import re

    for r in got:
        text = left[r["doc_id"]]
        if share[r["doc_id"]] == 0 and not any(re.search(x, text) for x in base):
            clean += 1
            assert bytes(r["ids"]) == coder.packed(text) and r["n_tokens"] == len(r["ids"]) // 4
        else:
            back = bpe.Utf8Stream(bpe.token_table(ranks)).decode(np.frombuffer(r["ids"], "<u4").tolist()).decode()
            assert not re.search(secrets.ACCESS, back) and not re.search(secrets.HEX, back) and not decontaminate.Automaton([(str(a), decontaminate.words_of(b)) for a, b in items]).scan(decontaminate.words_of(back))[0]
    assert clean > 50


def test_run_keeps_the_first_of_each_group_of_similar_texts(spark):
    """The near_dedup stage's own contract: shingles of five words, Jaccard similarity of 0.8 or more, by all pairs."""
    docs = table(spark, SF, "documents")
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = langid.fitted(docs)
    p = model.pooled([(t or "").encode() for t in rows.values()])
    left = [(d, t) for (d, t), q in zip(rows.items(), p, strict=True) if any(map(str.isalpha, t or "")) and q.max() >= corpus_pipeline.LANG_SCORE]
    keep = set(jaccard_kept(left))
    assert 0 < len(left) - len(keep) < len(left) // 2
    share = {d: hit / max(1, n) for d, n, hit, *_ in brute_hits([(d, t) for d, t in left if d in keep], items)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == {d for d in keep if share[d] <= 0.5} and all(r["same"] for r in got)


def test_stages_keep_the_columns_and_take_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
