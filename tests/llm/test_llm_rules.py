"""Repetition rules, URL filters and license scans against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

import edges
from changeflow.llm import license_scan, repetition, url_rules
from changeflow.llm.repetition import LINE_LIMIT, NGRAM_LIMITS, measure

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    text = text or ""
    spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
    words = [text[a:b] for a, b in spans]
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup_lines, dup_chars = set(), 0, 0
    for x in lines:
        if x in seen:
            dup_lines += 1
            dup_chars += sum(map(len, WORD.findall(x)))
        seen.add(x)
    out = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup_lines]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    out += [len(inside), dup_chars]
    for n in NGRAM_LIMITS:
        met, inside = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g in met:
                inside.update(range(i, i + n))
            met.add(g)
        out.append(sum(len(words[i]) for i in inside))
    failed = out[0] < 50 or 100 * out[4] > 50 * out[0]
    bad = failed or 100 * dup_chars > LINE_LIMIT * out[1]
    bad |= any(100 * c > limit * out[1] for c, limit in zip(out[6:], NGRAM_LIMITS.values(), strict=True))
    return [*out, failed, not bad]


def test_repetition_equals_a_plain_count():
    rng = random.Random(3)
    texts = [None, "", "a", "a\n\na \na", "#*$ %&|<>"]
    for _ in range(150):
        vocabulary = [rng.choice(["a", "bb", "é", "日本", "x\x00", "#|"]) + str(rng.randrange(9)) for _ in range(rng.randrange(1, 40))]
        texts.append("".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "\t", "  ", "\r\n"]) for _ in range(rng.randrange(160))))
    got = measure(texts)
    assert [list(r) for r in got.itertuples(index=False)] == [plain_counts(t) for t in texts]


def test_repetition_on_odd_rows(spark):
    got = repetition.repetition_rules(edges.documents(spark))
    assert edges.same_ids(got)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].base_failed and rows[3].n_words == 0 and rows[10].kept and rows[10].n_words == 60_000
    assert rows[8].n_dup_lines == 39 and not rows[8].kept
    assert repetition.repetition_rules(edges.empty(spark)).count() == 0
    kept = repetition.keep_unrepetitive(edges.documents(spark))
    assert kept.columns == edges.documents(spark).columns and [r.doc_id for r in kept.collect()] == [10]


def plain_verdict(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    fit.sort(key=lambda r: (-len(r.host + r.path), r.verdict != "block", r.host + r.path))
    return (host, path, fit[0].host + fit[0].path, fit[0].verdict) if fit else (host, path, None, "allow")


@pytest.mark.parametrize("few", [True, False])
def test_url_filters_equal_a_plain_search(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(url_rules, "BROADCAST_RULES", 0)
    rng = random.Random(5)
    hosts = ["net", "b.net", "a.b.net", "org", "x-net", "0", "é.org"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/b/", "/ab/", "//", "/é/"]
    rules = [url_rules.Rule(h, p, rng.choice(["allow", "block"])) for h in hosts for p in paths if rng.random() < 0.4]
    tails = ["", "?q=/a/", "#/a", "?x#y", "\n", "c"]
    urls = [
        rng.choice(["http://", "HTTPS://", "", "x:", "://", "a://b://"]) + rng.choice(["", "www.", "WWW.A.", "q."])
        + rng.choice(hosts).upper() + rng.choice(paths) + rng.choice(paths) + rng.choice(tails)
        for _ in range(300)
    ]
    urls += [None, "", "http://", "http://net", "http://net" + "/a" * 3000, "http://" + "a." * 100_000 + "net/a/b/c", "http://..net/", "http://.net./"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS host", "'x' AS rule")
    got = url_rules.judge_urls(pages, url_rules.rule_table(spark, rules)).collect()
    want = {i: plain_verdict(u, rules) for i, u in enumerate(urls)}
    assert {r.page_id: tuple(r)[1:] for r in got} == want and len(got) == len(urls)


def test_url_filters_on_empty_tables_and_repeats(spark):
    none = url_rules.rule_table(spark, [])
    pages = spark.createDataFrame([(1, "http://a/"), (1, "http://a/"), (None, "http://a/")], "page_id long, url string")
    assert url_rules.judge_urls(pages, none).count() == 3
    assert url_rules.judge_urls(pages.limit(0), none).count() == 0
    for bad in (("", "/"), ("A", "/"), ("a", "b")):
        with pytest.raises(ValueError):
            url_rules.Rule(*bad, "block")


def plain_license(text, templates, threshold):
    from collections import Counter

    keep = lambda t: "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789\n" or ord(c) > 127 else " " for c in re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = lambda s: Counter(zip(s.split(" "), s.split(" ")[1:], strict=False))
    lines = [re.sub(" +", " ", x).strip(" ") for x in keep(text or "").split("\n")]
    units = list(enumerate(lines, 1)) + ([(0, re.sub(" +", " ", " ".join(lines)).strip())] if len(lines) > 1 else [])
    found = []
    for line, s in units:
        a = grams(s)
        for name, template in templates.items():
            b = grams(" ".join(license_scan.template_words(template)))
            common = sum((a & b).values())
            dice = 2 * common / max(1, a.total() + b.total())
            if dice >= threshold:
                found.append((-dice, line, name, -common))
    where, words = [(n, w) for n, x in enumerate(lines, 1) for w in x.split()], " ".join(lines).split()
    pairs = list(zip(words, words[1:], strict=False))
    for name, template in templates.items():
        b = grams(" ".join(license_scan.template_words(template)))
        m = b.total()
        for at in range(len(pairs)):
            a = Counter(pairs[at : at + m])
            common = sum((a & b).values())
            dice = 2 * common / (a.total() + m)
            if dice >= threshold and pairs[at] in b:
                found.append((-dice, where[at][0], name, -common))
    each = {name: min(f for f in found if f[2] == name) for name in {f[2] for f in found}}
    best = min(((less, *f) for *f, less in each.values()), default=(None,) * 4)
    return len(each), best[3], best[2], -best[1] if found else None


def test_license_scan_equals_a_plain_scan(spark):
    rng = random.Random(9)
    texts = [r[1] for r in edges.ROWS if r[1] != edges.LONG]
    for _ in range(150):
        words = " ".join(rng.choice(list(license_scan.TEMPLATES.values())) for _ in range(rng.randrange(1, 3))).split()
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["the", "\n", "license", "é", "--"]))
        texts.append(" ".join(w for w in words if rng.random() > 0.04))
    docs = spark.createDataFrame(list(enumerate(texts)), edges.SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in license_scan.license_scan(docs).collect()}
    for i, t in enumerate(texts):
        want = plain_license(t, license_scan.TEMPLATES, license_scan.THRESHOLD)
        assert got[i][:3] == want[:3] and got[i][3] == (pytest.approx(want[3]) if want[3] else None), t


def test_notices_are_found_where_they_are_wrapped_or_embedded(spark):
    t = license_scan.TEMPLATES
    wrap = lambda text, n, mark: "\n".join(f"{mark} {' '.join(text.split()[i : i + n])}" for i in range(0, len(text.split()), n))
    code = "import os\n\ndef main():\n    return os.getcwd()\n" * 20
    texts = {
        "apache-2.0-header": "#!/usr/bin/env python\n" + wrap(t["apache-2.0-header"], 9, "#") + "\n" + code,
        "mit-text": "/*\n" + wrap("Copyright (c) 2020 Foo " + t["mit-text"], 7, " *") + "\n */\n" + code,
        "all-rights-reserved": "Copyright 2020 Foo Inc. All rights reserved. Use of this page is free.",
        "gpl-3.0": "The files are here. This work is licensed under the GNU General Public License, version 3. See below for more of them.",
        "bsd-3-clause": code + t["bsd-3-clause"].replace("the copyright holder", "Foo", 1) + " " + code.replace("\n", " "),
        "zlib": code * 5 + wrap(t["zlib"], 5, "//") + code,
        None: code + "the license of this work is under a version of the public domain, all rights of the software are free",
    }
    docs = spark.createDataFrame(list(enumerate(texts.values())), edges.SCHEMA)
    got = license_scan.license_scan(docs).orderBy("doc_id").collect()
    assert [r.license for r in got] == list(texts) and [r.line for r in got] == [2, 2, 1, 1, 81, 401, None]
    assert all(r.score > 0.9 for r in got if r.license)


def test_license_scan_on_odd_rows(spark):
    got = license_scan.license_scan(edges.documents(spark))
    assert edges.same_ids(got)
    assert {r.doc_id: r.license for r in got.where(F.col("license").isNotNull()).collect()} == {11: "apache-2.0"}
    assert license_scan.license_scan(edges.empty(spark)).count() == 0
    with pytest.raises(ValueError, match="fewer than two words"):
        license_scan.license_scan(edges.empty(spark), {"x": "one"})
