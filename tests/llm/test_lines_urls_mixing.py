"""Line dedup, URL filters and mixing: against SQL, plain Python, and odd input."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.llm import catalog, line_dedup, mixing, url_filter

from ..conftest import rows_of, rows_of_sql
from .helpers import LOWER, ODD, clashing, documents, rows, words


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    assert rows_of(catalog.QUERIES[name](spark, sf)) == rows_of_sql(duck, catalog.SQL[name])


# --- lines ------------------------------------------------------------------------------------------


def plain_lines(pairs, min_docs=2):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for doc, text in pairs:
        if doc is not None:
            for line in (text or "").split("\n"):
                holders[key(line)].add(doc)
    out = []
    for doc, text in pairs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(key(x)) < 10 or len(holders[key(x)]) < min_docs or min(holders[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_by_hand(spark):
    shared = "This line is shared by many"
    texts = [f"{shared}\nown first\n{shared}", f"  {shared.upper()} \t\nshort\nshort", f"a\n{shared}\nb\n\n{shared}\nc", "short\nshort", *ODD, "Größe ist ÜBERALL gleich\nx", "größe ist ÜBERALL gleich\ny"]
    docs = documents(spark, texts)
    found = line_dedup.drop_repeated_lines(docs)
    assert rows(found, "doc_id", "n_lines", "n_dropped", "kept_text") == plain_lines(list(enumerate(texts)))
    three = line_dedup.drop_repeated_lines(docs, min_docs=3)
    assert rows(three, "doc_id", "n_lines", "n_dropped", "kept_text") == plain_lines(list(enumerate(texts)), 3)


def test_lines_of_odd_tables(spark):
    line = "a line of some length"
    pairs = [(1, line), (1, line), (2, line), (None, line), (None, line + "\n" + line), (3, f"x\n{line}"), (3, f"{line}\nx\n{line}")]
    docs = spark.createDataFrame(pairs, "doc_id bigint, text string")
    own = ["_row", "_lines", "_cuts", "_drops", "_key", "key", "h1", "first", "pos", "line", "row", "a`b.c"]
    found = line_dedup.drop_repeated_lines(clashing(docs, "kept_text", "n_lines", *own))
    assert rows(found, "doc_id", "n_lines", "n_dropped", "kept_text") == plain_lines(pairs)
    assert found.columns == ["doc_id", "text", *own, "kept_text", "n_lines", "n_dropped"]
    assert all(set(r[2:-3]) == {"kept?"} for r in found.collect())
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_many_dropped_lines_keep_their_order(spark):
    lines = [f"common line number {k}" if k % 3 else f"own {k}" for k in range(900)]
    docs = documents(spark, ["\n".join(lines), "\n".join(reversed(lines))])
    found = rows(line_dedup.drop_repeated_lines(docs), "doc_id", "n_dropped", "kept_text")
    assert found[0][1] == 0 and found[1][1] == 600
    assert found[1][2].split("\n") == [x for x in reversed(lines) if x.startswith("own")]


# --- urls -----------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = {
        "http://Sub.Example.COM/en/x?q#f": ("sub.example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://a.www.example.com/en/1": ("a.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://example.com": ("example.com", "", None, None),
        "https://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
        "//no.scheme.com/": ("", "", None, None),
        "a://b.net/fr/://c.com/": ("b.net", "/fr/://c.com/", "net/fr/", "block"),
        "ftp://com/": ("com", "/", "com/", "allow"),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "http://ÜX.net/fr/\nz": ("Üx.net", "/fr/\nz", "net/fr/", "block"),
    }
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id bigint, url string")
    found = {r["url"]: r for r in url_filter.judge_urls(clashing(pages, "host", "verdict", "good")).collect()}
    for url, (host, path, rule, verdict) in urls.items():
        r = found[url]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        assert r["verdict"] == verdict or verdict is None and r["verdict"] in ("allow", "block")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_reputation_shrinks_to_what_stands_above(spark):
    outcomes = [(f"http://h{k}.bad.org/x", False) for k in range(30)] + [("http://one.good.org/x", True)] * 30 + [("http://fresh.good.org/", None)]
    pages = spark.createDataFrame([(1, "http://h1.bad.org/"), (2, "http://new.bad.org/"), (3, "http://new.good.org/"), (4, "http://other.net/")], "page_id bigint, url string")
    labelled = spark.createDataFrame(outcomes, "url string, good boolean")
    found = {r["page_id"]: r for r in url_filter.judge_urls(pages, rules=(), outcomes=labelled).collect()}
    assert [found[k]["verdict"] for k in (1, 2, 3, 4)] == ["block", "block", "allow", "allow"]
    assert found[1]["high"] <= found[2]["high"] < found[4]["high"] <= found[3]["high"] + 0.5
    assert url_filter.judge_urls(pages, rules=(), outcomes=labelled.limit(0)).where("verdict = 'block'").count() == 0


def plain_bounds(outcomes, hosts, z=1.645):
    """The upper bound of every host by plain loops: beta priors from suffix to domain to host, siblings' pages discounted."""
    domain = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda h: h.split(".")[-1]
    pages = {h: [good for g, good in outcomes if g == h] for h in {*hosts, *(h for h, _ in outcomes)}}
    count = {h: (len(p), sum(p)) for h, p in pages.items()}

    def likeness(groups, above):
        families = defaultdict(list)
        for g, (n, k) in groups.items():
            if n:
                families[above(g)].append((n, k))
        between = sum(len(f) - 1 for f in families.values())
        within = sum(n - 1 for f in families.values() for n, _ in f)
        if not between or not within:
            return 0.5
        b = w = m = 0.0
        for f in families.values():
            total, good = sum(n for n, _ in f), sum(k for _, k in f)
            b += sum(n * (k / n - good / total) ** 2 for n, k in f)
            w += sum(k * (1 - k / n) for n, k in f)
            m += total - sum(n * n for n, _ in f) / total
        b, w, m = b / between, w / within, m / between
        return min(0.99, max(0.01, (b - w) / (b + (m - 1) * w) if b + (m - 1) * w > 0 else 0.01))

    def summed(groups, rho, above):
        out = defaultdict(lambda: (0.0, 0.0))
        for g, (n, k) in groups.items():
            if n:
                a, b = out[above(g)]
                out[above(g)] = a + n / (1 + (n - 1) * rho), b + k / (1 + (n - 1) * rho)
        return out

    by_domain = defaultdict(lambda: (0, 0))
    for h, (n, k) in count.items():
        by_domain[domain(h)] = by_domain[domain(h)][0] + n, by_domain[domain(h)][1] + k
    rho_host, rho_domain = likeness(count, domain), likeness(by_domain, suffix)
    out = {}
    for h in hosts:
        rest = {g: c for g, c in count.items() if g != h and domain(g) == domain(h)}
        n_in, k_in = summed(rest, rho_host, domain)[domain(h)]
        elsewhere = summed(summed({g: c for g, c in count.items() if domain(g) != domain(h)}, rho_host, domain), rho_domain, suffix)
        n_by, k_by = elsewhere[suffix(h)]
        mean, weight = (k_by + 1) / (n_by + 2), n_by + 2
        for (n, k), rho in (((n_in, k_in), rho_domain), (count[h], rho_host)):
            own = (1 - rho) / rho
            prior = weight * own / (weight + own + 1)
            mean, weight = (k + prior * mean) / (n + prior), n + prior
        out[h] = min(1.0, mean + z * (mean * (1 - mean) / (weight + 1)) ** 0.5)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_reputation_against_plain_loops(spark, seed):
    """Outcomes that differ inside a suffix and inside a domain; verdicts follow each host's own evidence."""
    draw = random.Random(seed)
    rate = {f"h{h}.d{d}.{s}": draw.choice([0.02, 0.5, 0.98]) for s in ("org", "net", "com") for d in range(4) for h in range(4)}
    outcomes = [(h, draw.random() < r) for h, r in rate.items() for _ in range(draw.choice([0, 1, 3, 40]))]
    hosts = [*rate, "new.d0.org", "x.fresh.net", "a.b.unseen", "unseen"]
    pages = spark.createDataFrame([(k, f"http://{h}/p") for k, h in enumerate(hosts)], "page_id bigint, url string")
    labelled = spark.createDataFrame([(f"http://{h}/{k}", g) for k, (h, g) in enumerate(outcomes)], "url string, good boolean")
    found = {r["host"]: r for r in url_filter.judge_urls(pages, rules=(), outcomes=labelled).collect()}
    want = plain_bounds(outcomes, hosts)
    for h in hosts:
        assert abs(found[h]["high"] - want[h]) < 1e-9 and found[h]["verdict"] == ("block" if want[h] < 0.5 else "allow"), h
    assert {r["verdict"] for r in found.values()} == {"allow", "block"}


def test_an_unseen_suffix_is_not_judged_by_others(spark):
    bad = [(f"http://h{k}.d{k % 7}.{s}/{j}", False) for k in range(60) for s in ("org", "net", "info") for j in range(5)]
    labelled = spark.createDataFrame(bad, "url string, good boolean")
    pages = spark.createDataFrame([(1, "http://a.b.fresh/"), (2, "http://new.d1.org/"), (3, "http://one.other.net/"), (4, None)], "page_id bigint, url string")
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, rules=(), outcomes=labelled).collect()}
    assert found == {1: "allow", 2: "block", 3: "block", 4: "allow"}


def test_tied_rules_and_repeated_pages(spark):
    """Of rules of one length the later one wins; repeated pages are judged alike, and a bound of exactly one half allows."""
    pages = spark.createDataFrame([(1, "http://a.com/x")] * 3, "page_id bigint, url string")
    found = url_filter.judge_urls(pages, rules=(("allow", "a.com/"), ("block", "com/x/"), ("block", "a.com/"))).collect()
    assert [(r["rule"], r["verdict"]) for r in found] == [("a.com/", "block")] * 3
    open_ = url_filter.judge_urls(pages, rules=(), least_good=1.0).collect()
    assert {(r["high"], r["verdict"]) for r in open_} == {(1.0, "allow")}


def test_suffixes(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("x.y.com",), ("y.com",), ("com",), ("",)], "h string")
    found = rows(hosts, "h", url_filter.domain_of(F.col("h")), url_filter.suffix_of(F.col("h")))
    assert found == [("", "", ""), ("a.b.co.uk", "b.co.uk", "co.uk"), ("b.co.uk", "b.co.uk", "co.uk"), ("com", "com", "com"), ("x.y.com", "y.com", "com"), ("y.com", "y.com", "com")]


# --- mixing -------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, clamped = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in clamped]
        unit = (total - sum(clamped.values())) / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * unit > most * sizes[s]]
        if not over:
            return {s: clamped.get(s, weight[s] * unit) for s in names}
        clamped |= {s: most * sizes[s] for s in over}


def test_mixing_by_hand(spark):
    texts = [" ".join(["w"] * (1 + k * 37 % 400)) for k in range(600)] + ODD
    source = lambda k: [None, "zeta", "Alpha", "éclair", "big", "big", "big"][k % 7] if k < 600 else "odd"
    docs = documents(spark, texts, source)
    found = mixing.mix_sources(clashing(docs.drop("n_chars"), "size", "target", "_u")).collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for k, t in enumerate(texts):
        sizes[source(k)] += len(words(t))
        largest[source(k)] = max(largest[source(k)], len(words(t)))
    targets = plain_targets(sizes)
    assert len(found) == len(texts)
    for r in found:
        assert r["size"] == len(words(texts[r["doc_id"]])) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - targets[r["source"]]) < 1e-6 * max(1, targets[r["source"]])
        assert r["taken"] in (r["size"] * r["whole"], r["size"] * (r["whole"] + 1)) and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in found)


def test_mixing_of_odd_tables(spark):
    docs = documents(spark, ["a b c"] * 4, lambda k: None)
    found = mixing.mix_sources(docs).collect()
    assert [r["target"] for r in found] == [18.0] * 4 and sum(r["taken"] for r in found) == 18
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix_sources(documents(spark, [None, ""])).collect()} == {0}
    twice = docs.unionByName(docs).withColumn("doc_id", F.lit(None).cast("bigint"))
    assert mixing.mix_sources(twice).count() == 8


def test_hot_doc_ids_are_cut_by_count(spark):
    """Rows alike in doc_id and size, on which the cut falls, are taken as many as fit, and no task reads them all."""
    n = 30_000
    ids = spark.range(n, numPartitions=8).select(F.when(F.col("id") % 3 == 0, 7).cast("bigint").alias("doc_id"), F.lit("a b c d").alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    found = mixing.mix_sources(ids).groupBy("source", "target", "source_size").agg(F.sum("taken").alias("taken"), F.count("*").alias("n"), F.max("taken").alias("most")).collect()
    targets = plain_targets({r["source"]: r["source_size"] for r in found})
    for r in found:
        assert r["n"] == n // 2 and abs(r["target"] - targets[r["source"]]) < 1e-6 and abs(r["taken"] - r["target"]) <= 2 and r["most"] <= 8


def test_cut_among_ties_against_a_plain_walk(spark):
    """Few doc_ids, many sizes: what each (source, doc_id, size) gives equals a walk through the seeded order."""
    draw = random.Random(4)
    pairs = [(draw.choice([None, 1, 2, 3]), "w " * draw.choice([0, 1, 2, 5, 9]), draw.choice(["s", "t", None])) for _ in range(400)]
    docs = spark.createDataFrame(pairs, "doc_id bigint, text string, source string")
    sizes, want = defaultdict(int), defaultdict(int)
    for _, t, s in pairs:
        sizes[s] += len(words(t))
    targets = plain_targets(sizes)
    for s in sizes:
        whole = int(targets[s] // sizes[s])
        need, before = targets[s] - whole * sizes[s], 0
        order = [(hashlib.md5(f"{'' if d is None else d}:7".encode()).hexdigest(), len(words(t)), d) for d, t, x in pairs if x == s]
        for _, size, d in sorted(order, key=lambda o: o[:2]):
            want[s, d, size] += size * (whole + (need > 0 and before + size / 2 <= need))
            before += size
    found = mixing.mix_sources(docs).groupBy("source", "doc_id", "size").agg(F.sum("taken").alias("taken")).collect()
    assert {(r["source"], r["doc_id"], r["size"]): r["taken"] for r in found} == want


def test_repeated_documents(spark):
    docs = documents(spark, [f"t{k} " * (k + 1) for k in range(30)], lambda k: f"s{k % 2}")
    times = {r["doc_id"]: r["whole"] + r["extra"] for r in mixing.mix_sources(docs).collect()}
    own = ["_id", "_times", "_copy", "_u", "_key", "_row", "_cut", "_need", "whole", "size", "_SALT", "a`b"]
    out = mixing.repeat_documents(clashing(docs, *own))
    assert out.columns == [*docs.columns, *own] and all(set(r[len(docs.columns) :]) == {"kept?"} for r in out.collect())
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {k: n for k, n in times.items() if n}


def test_hashes_of_sql_and_spark_agree(spark):
    assert spark.range(1).select(F.sha2(F.lit("ä").cast("binary"), 256)).first()[0] == hashlib.sha256("ä".encode()).hexdigest()
