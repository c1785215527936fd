"""Extra columns with the names that the operators use themselves pass through those that pass columns on."""

import inspect
import re

import pytest
from pyspark.sql import functions as F

from brindle.llm import decontam, line_dedup, media, minhash, mixing, toxicity, url_filter
from brindle.llm import progressive_jpeg as jpeg

MODULES = (decontam, line_dedup, media, minhash, mixing, toxicity, url_filter)
#: Every name that is written as a text in any of the modules.
NAMES = sorted({n for m in MODULES for n in re.findall(r'"(_?[a-z][a-z0-9_]*)"', inspect.getsource(m))} | {"_id", "_x", "a`b", "with space", "dot.ted"})


@pytest.mark.parametrize("name", ["lines", "mixing", "decontam", "minhash", "toxicity", "urls", "media"])
def test_names_of_the_operators_own_pass(spark, name):
    docs = spark.createDataFrame([(1, "one two three four five six seven", "s"), (2, "one two three four five six seven", "t"), (None, None, None)], "doc_id bigint, text string, source string")
    (image,) = jpeg.write_payloads([bytes(64)], [b""])
    items = spark.createDataFrame([(1, "quite another text of some words")], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id bigint, url string")
    images = spark.createDataFrame([(1, bytearray(image)), (2, None)], "n bigint, media binary")
    frame, new, apply = {
        "lines": (docs, {"kept_text", "n_lines", "n_dropped"}, line_dedup.drop_repeated_lines),
        "mixing": (docs, set(), mixing.repeat_documents),
        "decontam": (docs, set(), lambda d: decontam.drop_leaking(d, items)),
        "minhash": (docs, set(), minhash.drop_near_duplicates),
        "toxicity": (docs, set(), lambda d: toxicity.drop_toxic(d, toxicity.fit(d, labels), threshold=2.0)),
        "urls": (pages, {"host", "path", "rule", "verdict", "high"}, url_filter.judge_urls),
        "media": (images, {"height", "width", "rgb", "error"}, media.decode_images),
    }[name]
    extra = [n for n in NAMES if n not in frame.columns]
    found = apply(frame.withColumns({n: F.lit("kept?") for n in extra}))
    passed = [n for n in extra if n not in new]
    assert set(frame.columns) | set(passed) | new == set(found.columns) and len(found.columns) == len(set(found.columns))
    rows = found.select(*["`" + n.replace("`", "``") + "`" for n in passed]).collect()
    assert rows and all(set(r) == {"kept?"} for r in rows)
