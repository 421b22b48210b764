"""The pipeline against a plain version of its five stages."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from . import brute  # noqa: E402


def _rows():
    r = random.Random(9)
    vocab = ["".join(r.choices("abcdeéñß", k=r.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choices(vocab, k=n))
    texts = [prose(r.randint(20, 200)) for _ in range(40)]
    texts += [texts[0], texts[1].upper(), texts[2], "", "1 2 3", "..."]
    long_ = prose(3000).split()
    for k in range(4):
        long_[k] = f"word{k}"
        texts.append(" ".join(long_))
    return [(i, t, "en" if i % 3 else "fr", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(None, prose(30), None, None, 5)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(_rows(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    return out


def _plain(rows):
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    by = {}
    for r in rows:
        key = "".join(c.lower() if c.isascii() else c for c in r[1])
        if key not in by or (r[0] is not None and (by[key][0] is None or r[0] > by[key][0])):
            by[key] = r
    rows = list(by.values())
    near = {x[0]: x[2] for x in brute.simhash([(r[0], r[1]) for r in rows])}
    return [r for r in rows if near[r[0]] in (r[0], None)]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
    left = docs.collect()
    assert Counter(map(tuple, left)) == Counter(_plain(_rows()))
    wanted = Counter()
    for (doc, _), n in brute.mix_times([(r.doc_id, r.text, r.source) for r in left]).items():
        wanted[doc] += n
    sizes, took, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in left:
        n = len(brute.words(r.text))
        sizes[r.source] += n
        took[r.source] += wanted[r.doc_id] * n
        largest[r.source] = max(largest[r.source], n)
    assert abs(sum(took.values()) - sum(sizes.values())) <= sum(largest.values())
    result = corpus_pipeline.run(spark, folder)
    rows = result.collect()
    assert Counter(r.doc_id for r in rows) == Counter({k: v for k, v in wanted.items() if v})
    text = {r.doc_id: r.text for r in left}
    from tokenizers import Tokenizer
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows:
        assert r.ids == library.encode(text[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert hashlib.sha256(r.decoded.encode()).digest() == hashlib.sha256(library.decode(r.ids, skip_special_tokens=False).encode()).digest()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
