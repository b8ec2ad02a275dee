import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigauge.llm import quality_rules, url_filters


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(5000).selectExpr("concat('k', id) as key")
    for listed in (["k3", "k77", "k4999"], [f"k{i}" for i in range(0, 5000, 7)], []):
        cascade = url_filters.build_cascade(url_filters._keys(spark, listed), universe)
        got = {r["key"] for r in universe.where(url_filters.is_listed(F.col("key"), cascade)).collect()}
        assert got == set(listed)


URLS = [
    (1, "http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    (2, "https://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
    (3, "https://m.example.com/en", "m.example.com", "/en", "com/", "allow"),
    (4, "http://a.net/fr/1", "a.net", "/fr/1", "net/fr/", "block"),
    (5, "http://a.net/de/1", "a.net", "/de/1", None, "allow"),
    (6, "http://x.spam-farm.example.org/de", "x.spam-farm.example.org", "/de", None, "block"),
    (7, "http://notspam-farm.example.org", "notspam-farm.example.org", "", None, "allow"),
    (8, None, "", "", None, "allow"),
    (9, "no scheme", "", "", None, "allow"),
    (10, "http://", "", "", None, "allow"),
    (11, "http://example.com?x=/en/", "example.com", "", None, "allow"),
    (12, "a://b://c.com/x", "b:", "//c.com/x", None, "allow"),
    (12, "a://b://c.com/x", "b:", "//c.com/x", None, "allow"),
    (None, "http://ÄÖ.com/É", "ÄÖ.com", "/É", "com/", "allow"),
]


def test_url_filter_cases(spark):
    rows = spark.createDataFrame([(i, u, "h", "r") for i, u, *_ in URLS], "page_id bigint, url string, host string, rule string")
    got = url_filters.url_filter(rows)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    wanted = Counter((i, h, p, r, v) for i, _, h, p, r, v in URLS)
    assert Counter(map(tuple, got.collect())) == wanted
    assert url_filters.url_filter(rows.limit(0)).count() == 0


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


CASES = ["a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n\n x\nx", "# $%&|<> \x1c é", "a b c d e f a b c d e g a b c d e", "\x0b\x0ca\rb"]


def test_counts_against_brute_force(spark, odd_documents):
    extra = spark.createDataFrame([(100 + k, t, "en") for k, t in enumerate(CASES)], "doc_id bigint, text string, lang string")
    docs = odd_documents.select("doc_id", "text", "lang").unionByName(extra)
    labels = spark.createDataFrame([(100, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_rules.quality_rules(docs, labels).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter((r["doc_id"], *[r[n] for n in names]) for r in got) == Counter((r["doc_id"], *brute_counts(r["text"])) for r in docs.collect())
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] <= (not r["base_failed"])
    assert quality_rules.quality_rules(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("x,n,p", [(0, 100, 0.05), (3, 500, 0.02), (10, 1000, 0.02), (0, 10, 0.5), (50, 40000, 0.005)])
def test_binomial_tail(x, n, p):
    brute = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(x + 1))
    assert quality_rules.binomial_tail(x, n, p) == pytest.approx(brute, rel=1e-9)


def test_cutoffs_stop_at_the_first_failure():
    rejected = {r: [0] * len(c) for r, c in quality_rules.CUTOFFS.items()}
    rejected["symbol_ratio"] = [0, 0, 500, 0, 0, 0, 0]
    got = {r: c for s, r, c in quality_rules.certified_cutoffs([("en", 10_000, rejected)])}
    assert got["symbol_ratio"] == quality_rules.CUTOFFS["symbol_ratio"][1]
    assert got["repeat_ratio"] == quality_rules.CUTOFFS["repeat_ratio"][-1]
    assert quality_rules.certified_cutoffs([("es", 20, rejected)]) == []


def test_junk_is_rejected_and_clean_text_kept(spark):
    clean = [(k, " ".join(f"word{k}x{j}" for j in range(60)), "en") for k in range(3000)]
    junk = [(5000 + k, " ".join(f"w{k}x{j}$$$" for j in range(60)), "en") for k in range(50)]
    docs = spark.createDataFrame(clean + junk, "doc_id bigint, text string, lang string")
    labels = docs.selectExpr("doc_id", "cast(doc_id < 5000 as int) as quality", "0 as toxic")
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(3000))
