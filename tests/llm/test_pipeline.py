"""The pipeline, stage by stage, against plain forms of what each stage promises, not against its own operators."""

import hashlib
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from brindle.llm import toxicity

from . import plain
from .helpers import words
from .test_lines_urls_mixing import plain_targets
from .test_minhash import components


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The documents before and after each stage, as rows."""
    path = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], sf).write.parquet(f"{path}/{name}")
        seen.append(spark.read.parquet(f"{path}/{name}"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "tokens"]
    assert all(f.columns == docs.columns for f in seen[:-1])
    return [f.collect() for f in seen]


def ids(rows):
    return {r["doc_id"] for r in rows}


def test_toxicity_drops_what_scores_high(spark, sf, stages):
    before, after = stages[0], stages[1]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    weight_of = plain.feature_weights(model, [r["text"] for r in before])
    assert ids(before) - ids(after) == {r["doc_id"] for r in before if plain.toxic_score(r["text"], weight_of, model.bias) >= 0.3}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    gone = ids(before) - ids(after)
    caught = [d in gone for d, t in toxic.items() if t == 1 and d in ids(before)]
    assert sum(caught) >= 0.7 * len(caught) and sum(toxic.get(d) == 0 for d in gone) <= 0.05 * len(before)


def test_one_document_of_each_component_stays(stages):
    before, after = stages[1], stages[2]
    of = components([(r["doc_id"], r["text"]) for r in before], percent=80)
    assert ids(after) == {d for d, c in of.items() if d == c} and len(after) < len(before)


def test_documents_with_items_go(spark, sf, stages):
    before, after = stages[2], stages[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {d for d, _ in plain.leaks([(r["doc_id"], r["text"]) for r in before], items)}
    assert held and ids(after) == ids(before) - held


def test_documents_are_repeated_as_the_mix_takes_them(stages):
    before, after = stages[3], stages[4]
    sizes, want = defaultdict(int), Counter()
    for r in before:
        sizes[r["source"]] += len(words(r["text"]))
    targets = plain_targets(sizes)
    for s in sizes:
        whole = int(targets[s] // sizes[s]) if sizes[s] else 0
        need, at = targets[s] - whole * sizes[s], 0
        own = sorted((hashlib.md5(f"{r['doc_id']}:7".encode()).hexdigest(), len(words(r["text"])), r["doc_id"]) for r in before if r["source"] == s)
        for _, size, d in own:
            want[d] += whole + (need > 0 and at + size / 2 <= need)
            at += size
    assert Counter(r["doc_id"] for r in after) == +want
    of = {r["doc_id"]: tuple(r) for r in before}
    assert all(tuple(r) == of[r["doc_id"]] for r in after)


def test_tokens_are_the_tokenizers(stages):
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    own, at = Tokenizer.from_file(public.path("word_bpe_49k.json")), 0
    before, after = sorted(stages[4], key=lambda r: r["doc_id"]), sorted(stages[5], key=lambda r: r["start"])
    assert [r["doc_id"] for r in after] == [r["doc_id"] for r in before]
    for doc, r in zip(before, after, strict=True):
        found = [*own.encode(doc["text"] or "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(found), zlib.crc32(np.array(found, "<u4").tobytes()))
        at += len(found)


def test_empty_documents(spark, sf, tmp_path):
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf)
        assert none.count() == 0
