"""The registered queries over whole tables, against plain Python."""

import hashlib
import os

import numpy as np
import pytest

from millrace.llm import quality, queries, toxicity
from millrace.llm.common import read_table
from tests.llm import brute
from tests.llm.test_operators import SMALL, TOKENIZER

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in read_table(spark, SMALL, "documents").collect()]


def _rows(spark, name, key="doc_id"):
    rows = queries.QUERIES[name](spark, SMALL).collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1_and_op4(spark, docs):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(TOKENIZER)
    got, lengths = _rows(spark, "op1_bpe"), []
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        lengths.append(len(ids))
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == _sha(library.decode(ids, skip_special_tokens=False))
    table = queries.QUERIES["op4_token_counts"](spark, SMALL).collect()
    assert sorted(r.context_limit for r in table) == sorted(set(lengths))
    for r in table:
        c = r.context_limit
        assert (r.n_docs, r.docs_over, r.docs_within) == (lengths.count(c), sum(x > c for x in lengths), sum(x <= c for x in lengths))
        assert (r.tokens_within, r.tokens_truncated) == (sum(x for x in lengths if x <= c), sum(min(x, c) for x in lengths))
        assert r.tokens_lost == sum(lengths) - r.tokens_truncated and r.quantile == pytest.approx(r.docs_within / len(lengths))


def test_op3(spark, docs):
    for i, r in _rows(spark, "op3_secrets").items():
        want = brute.base_secrets(dict(docs)[i])
        said = [f"{k}:{s}:{e}" for s, k, e in want]
        assert r.base_sha256 == _sha(",".join(said)) and set(said) <= set(filter(None, r.spans.split(",")))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in want) for kind in ("assign", "access", "hex"))


def test_op6(spark, docs):
    got = {i: (r.n_shingles, r.component_id) for i, r in _rows(spark, "op6_ngram_jaccard_join").items()}
    assert got == brute.jaccard_components(docs, 4, 85)


def test_op8(spark):
    pages = {r.page_id: r for r in read_table(spark, SMALL, "pages").collect()}
    for i, r in _rows(spark, "op8_html_extract", "page_id").items():
        want = brute.template_text(pages[i].html)
        assert (r.url, r.text, r.n_chars) == (pages[i].url, want, len(want))


def test_op9_and_op10(spark, docs):
    got = _rows(spark, "op9_line_dedup")
    for (i, _), (kept, n, dropped) in zip(docs, brute.dedup_lines([t for _, t in docs], 10), strict=True):
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (n, dropped, _sha(kept))
    items = [(r.item_id, r.text) for r in read_table(spark, SMALL, "benchmark").collect()]
    found, some = _rows(spark, "op10_decontaminate"), 0
    # Windows by their words: the plain version looks at all of each text.
    by_window = {}
    for name, text in items:
        words = brute.WORD.findall((text or "").translate(brute.LOWER))
        n = min(13, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            by_window.setdefault(tuple(words[k : k + n]), set()).add(str(name))
    sizes = {len(w) for w in by_window}
    for i, t in docs:
        words, hit, names = brute.WORD.findall((t or "").translate(brute.LOWER)), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if own := by_window.get(tuple(words[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= own
        r = found[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(words), len(hit), len(names), _sha(",".join(sorted(names))))
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(words))
        some += r.contaminated
    assert some


def test_op2_and_op5_scores(spark, docs):
    table, labels = read_table(spark, SMALL, "documents"), read_table(spark, SMALL, "labels")
    model = quality.train(table, labels)
    got = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    assert all(got[i] == pytest.approx(brute.quality_score(model, t), abs=1e-4) for i, t in docs[:60])
    from pyspark.sql import functions as F

    three = labels.select("doc_id", (1 - F.col("quality")).alias("unwanted"), F.when(F.col("doc_id") % 3 > 0, F.col("toxic")).alias("some"), "toxic")
    names = ("unwanted", "some", "toxic")
    chain = toxicity.train(table, three, names)
    assert [len(link.d) for link in chain.links] == [0, 1, 2]  # each link reads the probabilities of all before it
    for r in toxicity.score(table, chain).where(F.col("doc_id") % 2 == 0).collect():
        assert [r[f"p_{n}"] for n in names] == pytest.approx(brute.chain_scores(chain, r.text), abs=1e-9)


def test_op2_held_out(spark):
    got, labels = _rows(spark, "op2_quality"), {r.doc_id: r.quality for r in read_table(spark, SMALL, "labels").collect()}
    held = [(r.predicted, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert np.mean([a == b for a, b in held]) > 0.8


def test_op7(spark):
    rows = {r.vec_id: r.embedding for r in read_table(spark, SMALL, "embeddings").collect()}
    x = np.array(list(rows.values()), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = (x @ x.T >= 0.95).sum(1) - 1
    assert {i: r.n_links for i, r in _rows(spark, "op7_embedding_dedup", "vec_id").items()} == dict(zip(rows, n.tolist(), strict=True))
