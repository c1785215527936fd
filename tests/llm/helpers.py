"""Texts and plain forms of the operators' rules that tests compare with."""

import random
import re

SPACE = r"[\x20\x09-\x0D]"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Null, empty, blank, short, mixed scripts, and bytes at the edges of what UTF-8 writes.
ODD = [None, "", " \n\t", "one", "Ünï Çödé ÀÉ naïve café", "中文 テキスト 한국어", "a\x0bb\x0cc\rd", "x" * 5000, "1,234.5 kg − 7 %", "“Quote” – dash…", "\u00a0nb\u00a0sp", "emoji 😀 end"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, width=5):
    found = words(text)
    if not found:
        return set()
    return {tuple(found[k : k + width]) for k in range(max(1, len(found) - width + 1))}


def prose(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def documents(spark, texts, source=None):
    rows = [(k, t, "en", source(k) if source else "s", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(frame, *names):
    """The frame with more columns, under names that an operator uses for its own."""
    from pyspark.sql import functions as F

    return frame.withColumns({n: F.lit("kept?") for n in names})


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
