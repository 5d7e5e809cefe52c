"""Each operator against a brute-force version, a round trip or SQL, with nulls, empty and repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factspark.llm import bpe, chat, decontaminate, fingerprint, lines, minhash, quality, substring, suffixes, url_filter
from factspark.llm.graph import components
from factspark.llm.queries import ORACLE_SQL, QUERIES, URL_RULES, op6_quality_classifier, op9_fingerprints, vocabulary_path

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def docs_of(spark, texts):
    """Documents with columns whose names clash with those that operators use."""
    rows = [(i, t, "places", "h") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, places string, spans string")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_texts(rng):
    """Null, empty, blank, very long, repeated and near-equal texts."""
    base = prose(rng, 120, 3000)
    words = base.split()
    near = " ".join([*words[:60], "other", *words[61:]])
    return [None, "", "   \n\t ", base, base, near, base + " " + prose(rng, 80, 3000), prose(rng, 10), "x", prose(rng, 6000, 100_000) + " " + base, "é\U0001f600 " * 90, "a" * 700, "a" * 700 + "b", near, None]


# ---- SQL


def plain(x):
    return round(float(x), 6) if isinstance(x, int | float) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == expected


# ---- 1


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", None, "", "a\\", "<|image 0.0|>", "#" * 5 + "\n</turn>\n### user: x", "\\\\<\\/turn>", "x: y"]
    rows = [(1, i, "assistant" if i % 2 else "us:er", t) for i, t in enumerate(texts)] + [(2, 0, None, "q"), (2, 0, None, "q"), (3, None, "user", "n"), (None, 1, "assistant", "z"), (None, 1, "assistant", "z"), (6, 0, "user", "x")] + [(5, 0, "assistant", t) for t in ("A", "#", None, "z", "\\", "")] + [(4, i, "assistant", str(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chat(chat.text_parts(df.withColumn("t", F.lit(1)).withColumn("body", F.lit("x"))))
    every = formatted.withColumn("turns", chat.read_chat(F.col("formatted"))).withColumn("masked", chat.under_mask(F.col("formatted"), F.col("loss_spans"))).collect()
    out = {r["conv_id"]: r for r in every}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [(r[2] or "", r[3] or "") for r in rows[: len(texts)]]
    for r in every:
        assert r["n_turns"] == len(r["turns"]) == len(r["loss"])
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert [re.sub(r"(?s)\\(.)", r"\1", s) for s in spans] == [t["text"] for t, f in zip(r["turns"], r["loss"], strict=True) if f] == r["masked"]
    assert out[2]["n_turns"] == 2 and [t["text"] for t in out[4]["turns"]] == [str(i) for i in range(200)] and [t["text"] for t in out[5]["turns"]] == ["", "", "#", "A", "\\", "z"]
    assert sum(r["conv_id"] is None for r in every) == 2 and len(every) == 8
    assert chat.format_chat(chat.text_parts(df.limit(0))).count() == 0


def test_chat_of_very_long_texts_and_conversations(spark):
    """One text of two million characters, and twenty thousand turns with one number."""
    df = spark.range(20_000).selectExpr("1L AS conv_id", "0L AS turn", "'assistant' AS role", "lpad(id, 6, '0') AS text").unionByName(spark.range(1).selectExpr("2L AS conv_id", "id AS turn", "'assistant' AS role", "repeat('#', 2000000) AS text"))
    out = chat.format_chat(chat.text_parts(df)).select("conv_id", "n_turns", F.array_join(chat.under_mask(F.col("formatted"), F.col("loss_spans")), "").alias("loss")).collect()
    got = {r["conv_id"]: (r["n_turns"], r["loss"]) for r in out}
    assert got == {1: (20_000, "".join(f"{i:06d}" for i in range(20_000))), 2: (1, "#" * 2_000_000)}


def test_chat_parts(spark):
    parts = [("text", "see <|", None, None), ("image", None, "img.png", 256), ("audio", None, "a.wav", 3), ("video", None, "v", 1), ("document", None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_chat(df).first()
    assert r["formatted"] == "### user: see <\\|<|image 0.1|><|audio 0.2|><|document 0.4|></turn>\n### assistant: </turn>\n"
    assert [tuple(a) for a in r["attachments"]] == [(0, 1, "image", "img.png", 256), (0, 2, "audio", "a.wav", 75), (0, 4, "document", "", 0)] and r["attachment_tokens"] == 331


# ---- 2


def brute_hits(text, items, size):
    words, hit, found = decontaminate.words_of(text), set(), set()
    for k, item in items:
        w = decontaminate.words_of(item)
        n = min(len(w), size)
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(k))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [10_000, 12])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randrange(0, 12), 4)) for i in range(12)] + [(90, None), (91, "W1, w2! W3?"), (92, "w1 w2 w3")]
    texts = [prose(rng, rng.randrange(0, 80), 4) for _ in range(40)] + [None, "", "W1-W2/w3"]
    got = decontaminate.decontamination_report(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), 5).collect()
    for r in got:
        n, hit, found = brute_hits(texts[r["doc_id"]], items, 5)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(found), sha(",".join(found)), hit > 0)
    assert len(got) == len(texts)


def test_decontamination_does_not_depend_on_blocks(spark, monkeypatch):
    """Coverage is of the whole text and all items; repeated rows and ids give rows each; a window of all items counts for all."""
    items = spark.createDataFrame([(f"i{k}", f"a{k} b{k} c{k} d{k} e{k} s t u v w") for k in range(6)], "item_id string, text string")
    rows = [(1, "x " * 10 + "a1 b1 c1 d1 e1 and a2 b2 c2 d2 e2"), (1, "x " * 10 + "a1 b1 c1 d1 e1 and a2 b2 c2 d2 e2"), (1, "other a3 b3 c3 d3 e3"), (2, "s t u v w"), (None, "a1 b1 c1 d1 e1"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    results = []
    for block, held in ((10_000, 1 << 20), (10, 1 << 20), (10, 1)):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        monkeypatch.setattr(decontaminate, "HELD_BYTES", held)
        report = sorted((tuple(r) for r in decontaminate.decontamination_report(docs, items, 5).collect()), key=str)
        results.append((report, [sorted(map(str, decontaminate.remove_contaminated(docs, items, 5, max_coverage=c).collect())) for c in (0.3, 0.5, 1)]))
    assert results[0] == results[1] == results[2] and len(results[0][0]) == len(rows)
    assert {r[3] for r in results[0][0] if r[0] == 2} == {6} and not any("doc_id=1, text='x" in x for x in results[0][1][0]) and sum("doc_id=1, text='x" in x for x in results[0][1][1]) == 2


def test_decontamination_removes(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    texts = ["clean text", "a b c d e f One two, three four five six seven eight nine ten! g", None]
    assert [r["doc_id"] for r in decontaminate.remove_contaminated(docs_of(spark, texts), items).collect()] == [0, 2]
    cut = decontaminate.remove_contaminated(docs_of(spark, texts), items, max_coverage=0.9).collect()
    assert [r["text"] for r in cut] == ["clean text", "a b c d e f ! g", None]
    assert decontaminate.remove_contaminated(docs_of(spark, texts), items.limit(0)).count() == 3


# ---- 3


def brute_lines(rows, t, least):
    import itertools

    def close(a, b):
        return abs(len(a) - len(b)) <= t and distance(a, b) <= t

    first = {}
    for d, x in rows:
        for p, line in enumerate(dict.fromkeys(x.split("\n")) if x is not None else ()):
            if len(line) >= least:
                first.setdefault(line, (d, p))
    known = sorted(first, key=first.get)
    gone = {b for a, b in itertools.combinations(known, 2) if close(a, b)}
    out = {}
    for d, x in rows:
        every = x.split("\n") if x is not None else []
        order = list(dict.fromkeys(every))
        kept = [line for i, line in enumerate(every) if len(line) < least or (line not in gone and first[line] == (d, order.index(line)) and every.index(line) == i)]
        out[d] = (len(every), len(every) - len(kept), sha("\n".join(kept)))
    return out


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
def test_line_dedup(spark, threshold):
    rng = random.Random(threshold)
    base = ["".join(rng.choice("abcd é") for _ in range(rng.randrange(4, 24))) for _ in range(25)]

    def edit(line):
        line = list(line)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(line) + 1)
            if rng.random() < 0.5:
                line.insert(i, rng.choice("abcd"))
            elif line:
                line.pop(i - 1)
        return "".join(line)

    texts = ["\n".join(edit(rng.choice(base)) for _ in range(rng.randrange(1, 5))) for _ in range(90)] + [None, "", "\n\n", "same line here\nsame line here"]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in lines.line_report(docs_of(spark, texts), threshold, 6).collect()}
    assert got == brute_lines(list(enumerate(texts)), threshold, 6)


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
def test_bit_parallel_distance(spark, threshold):
    rng = random.Random(threshold)
    rows = [("", ""), ("", "a"), ("abc", ""), ("\U0001f600\U0001f601x", "\U0001f601\U0001f600x")]
    for _ in range(400):
        a = [rng.choice("ab\u00e9\U0001f600") for _ in range(rng.randrange(9))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice(["", "a", "\U0001f601", "b"])
        rows.append(("".join(a), "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", lines.within(F.col("a"), F.col("b"), threshold).alias("near")).collect()
    assert all(r["near"] == (distance(r["a"], r["b"]) <= threshold) for r in got) and len({r["near"] for r in got}) == 2


def test_line_dedup_of_rows_that_share_an_id(spark):
    """Each row keeps its own lines: only what an earlier row, or the one with the smaller hash, holds goes; equal rows lose the same."""
    rows = [(2, "common line of some length 1\nfirst row has this other text"), (2, "common line of some length 2\nanother unique row text kept"), (2, "common line of some length 2\nanother unique row text kept"), (1, "nothing like it in any way at all"), (None, "common line of some length 1\nx\nx"), (5, "first row has this other test\nand the last unique one of all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    mark = dict(docs.filter("doc_id = 2").select("text", F.xxhash64("text")).collect())
    order = sorted({r for r in rows if r[0] == 2}, key=lambda r: mark[r[1]])
    keep = {order[0][1]: order[0][1], order[1][1]: order[1][1].split("\n")[1]}
    expected = [(i, keep.get(t, t)) for i, t in rows[:5]] + [(5, "and the last unique one of all")]
    got = [(r["doc_id"], r["text"]) for r in lines.dedup_lines(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    report = {(r["doc_id"], r["n_lines"], r["n_removed"]) for r in lines.line_report(docs).collect()}
    assert report == {(1, 1, 0), (2, 2, 0), (2, 2, 1), (None, 3, 0), (5, 2, 1)}


@pytest.mark.parametrize("kind", ["letters", "numbers"])
def test_line_dedup_of_common_beginnings(spark, monkeypatch, kind):
    """Many lines with one long beginning, far apart behind it or near each other throughout: as by brute force."""
    monkeypatch.setattr(lines, "HOT", 5)
    monkeypatch.setattr(lines, "PIVOTS", 4)
    rng = random.Random(9)
    rest = (lambda: "".join(rng.choice("abcdefghijkl") for _ in range(8))) if kind == "letters" else (lambda: f"{rng.randrange(3000):04d}")
    texts = ["\n".join("the same beginning of every line " + rest() for _ in range(rng.randrange(1, 4))) for _ in range(110)]
    texts += [t.replace("beginning", "begining") for t in texts[::9]] + [t + rng.choice("xy") for t in texts[::7]]
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in lines.line_report(docs).collect()}
    assert got == brute_lines(list(enumerate(texts)), 2, 20)


def test_line_dedup_texts(spark):
    texts = ["a line of some length\nunique to the first", "a line of some length\nnew and different here", "a line of some lengths", None, "", "ok"]
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, texts)).collect()}
    assert out == {0: texts[0], 1: "new and different here", 3: None, 4: "", 5: "ok"}
    assert lines.dedup_lines(docs_of(spark, texts)).columns == docs_of(spark, texts).columns and lines.line_report(docs_of(spark, texts).limit(0)).count() == 0


def test_line_dedup_short_lines(spark):
    """Equal lines of any length go but the first; short ones that are only near, and empty ones, stay."""
    rng = random.Random(8)
    short = ["x", "xy", "xz", "And so on.", "And so on!", "Les.", "\u00e9\u00e9", " ", ""]
    texts = ["\n".join(rng.choice(short) if rng.random() < 0.6 else f"line {rng.randrange(10**12):040d}" for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        every = t.split("\n")
        kept = [x for x in every if x == "" or not (x in seen or seen.add(x))]
        if len(kept) == len(every) or any(kept):
            expected[i] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, texts)).collect()} == expected


# ---- 4


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://x.org/", "x.org", "/", "org/", "allow"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://q.com/de/#f", "q.com", "/de/", "com/de/", "block"), ("http://com/fr/a", "com", "/fr/a", "com/fr/", "allow"),
        ("http://x.org", "x.org", "", None, "allow"), ("no url", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://x.net?a/b", "x.net", "", None, "allow"), ("http://orgs/", "orgs", "/", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    df = url_filter.with_rules(url_filter.with_host_path(spark.createDataFrame([(url,)], "url string")), URL_RULES)
    r = df.select("host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict")).first()
    assert tuple(r) == (host, path, rule, verdict)


def test_url_rules_of_any_number(spark):
    rules = [("block", f"h{i}.net", "/a") for i in range(3000)] + [("allow", "net", "/"), ("allow", "h7.net", "/a"), ("block", "h8.net", "/a/b")]
    urls = ["http://x.h2999.net/ab", "http://h7.net/a", "http://h8.net/a/b", "http://q.net/", "http://q.org/"]
    df = url_filter.with_rules(url_filter.with_host_path(spark.createDataFrame([(u,) for u in urls], "url string")), rules)
    assert {r["url"]: (r["rule"], r["by_rule"]) for r in df.collect()} == dict(zip(urls, [("h2999.net/a", "block"), ("h7.net/a", "allow"), ("h8.net/a/b", "block"), ("net/", "allow"), (None, None)], strict=True))


def brute_tree(pages, labels):
    """template and verdict of each (host, form) by the stated rules, in plain Python."""
    u = url_filter

    def form(path):
        def of(x):
            if re.fullmatch(r"[0-9]+", x):
                return "{n}"
            if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", x):
                return "{date}"
            if re.fullmatch(r"[0-9a-fA-F]{8,}(-[0-9a-fA-F]+)*", x):
                return "{hex}"
            if re.fullmatch(r"[0-9]+\.[A-Za-z]+", x):
                return "{n}." + x.split(".")[1]
            return re.sub(r"[0-9]{3,}", "{n}", x)

        return tuple(of(x) for x in path.split("/") if x)

    marks = defaultdict(list)
    for i, bad in labels:
        if bad is not None:
            marks[i].append(bad)
    leaves = defaultdict(lambda: [0, 0])
    for i, host, path in pages:
        x = leaves[host, form(path)]
        x[0] += len(marks[i])
        x[1] += sum(marks[i])

    def classes(children):
        held = {c: "" for c in children}
        while True:
            sums = defaultdict(lambda: [0, 0])
            for c, (n, bad) in children.items():
                sums[held[c]][0] += n
                sums[held[c]][1] += bad
            moved = {}
            for c, (n, bad) in children.items():
                rest, rest_bad = sums[held[c]][0] - n, sums[held[c]][1] - bad
                pooled = (bad + rest_bad) / (n + rest) if n + rest else 0
                if n >= u.LEAST and rest >= u.LEAST and 0 < pooled < 1:
                    z = (bad / n - rest_bad / rest) / (pooled * (1 - pooled) * (1 / n + 1 / rest)) ** 0.5
                    if abs(z) > u.Z:
                        moved[c] = held[c] + ("+" if z > 0 else "-")
            if not moved:
                return held
            held |= moved

    template = {}

    def grow(members, t, level):
        n, bad = (sum(leaves[m][k] for m in members) for k in (0, 1))
        if n < 2 * u.LEAST or not 0 < bad < n or not any(len(f) > level for _, f in members):
            template.update({m: t + ("/**" if len(m[1]) > level else "") for m in members})
            return
        by = defaultdict(list)
        for m in members:
            by[m[1][level] if len(m[1]) > level else ""].append(m)
        held = classes({c: tuple(sum(leaves[m][k] for m in ms) for k in (0, 1)) for c, ms in by.items()})
        for k in set(held.values()):
            some = [c for c in by if held[c] == k]
            token = "/*" + k if len(some) > 1 else "/" + some[0] if some[0] else ""
            grow([m for c in some for m in by[c]], t + token, level + 1)

    for host in {h for h, _ in leaves}:
        grow([m for m in leaves if m[0] == host], "", 0)
    n, bad = (sum(x[k] for x in leaves.values()) for k in (0, 1))
    base = bad / n if n else 0
    sums = defaultdict(lambda: [0, 0])
    for m, x in leaves.items():
        for k in (0, 1):
            sums[m[0], template[m]][k] += x[k]
    pure = {k: (b + u.SMOOTH * base) / (n + u.SMOOTH) if n >= u.LEAST else 0 for k, (n, b) in sums.items()}
    return {i: (template[h, form(p)], "block" if pure[h, template[h, form(p)]] >= u.REJECT else "allow") for i, h, p in pages}


def same_as_brute_tree(spark, pages, labels):
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "id long, url string, host string, form string")
    out = url_filter.judge_urls(df, spark.createDataFrame(labels, "id long, bad boolean"), []).collect()
    assert len(out) == len(pages)
    brute = brute_tree([(r["id"], r["host"], r["path"]) for r in out], labels)
    assert {r["id"]: (r["template"], r["verdict"]) for r in out} == brute
    return {r["id"]: r for r in out}


def test_url_templates(spark):
    pages = [(i, f"http://h.net/{kind}/{i}") for i, kind in enumerate(["spam"] * 40 + ["news"] * 60 + ["blog"] * 60)] + [(900, "http://h.net/spam/1234"), (901, "http://h.net/news/77"), (902, None), (902, None)]
    labels = [(i, i < 38) for i in range(160)]
    by = same_as_brute_tree(spark, pages, labels)
    assert by[900]["verdict"] == "block" and by[901]["verdict"] == "allow" and by[902]["verdict"] == "allow"
    assert by[900]["template"].startswith("/spam") and by[901]["template"].startswith("/*-/")  # news and blog are alike
    assert {r["verdict"] for r in same_as_brute_tree(spark, pages, []).values()} == {"allow"}
    assert url_filter.judge_urls(spark.createDataFrame([], "id long, url string"), spark.createDataFrame(labels, "id long, bad boolean"), URL_RULES).count() == 0


def test_url_templates_of_any_depth(spark):
    """Branches that part at the fifth segment, and similar ones that merge with each other: two bad, two good, one between."""
    pages = [(i, f"http://h.net/a/b/c/d/{'bad' if i < 60 else 'good'}/{i}") for i in range(120)]
    pages += [(1000 + i, f"http://g.net/{'abcde'[i % 5]}/" + "deep/" * 300 + f"p{'q' * (i % 3)}") for i in range(500)]
    labels = [(i, i < 60) for i in range(120)] + [(1000 + i, i % 5 < 2 or (i % 5 == 4 and i % 2 == 0)) for i in range(500)]
    by = same_as_brute_tree(spark, pages, labels)
    assert all(by[i]["verdict"] == ("block" if i < 60 else "allow") for i in range(120))
    assert by[1000]["template"].split("/")[1] == by[1001]["template"].split("/")[1] != by[1002]["template"].split("/")[1] == by[1003]["template"].split("/")[1] != by[1004]["template"].split("/")[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_url_templates_at_random(spark, seed):
    rng = random.Random(seed)
    words = ["en", "de", "x1", "12", "2024-01-02", "deadbeef01", "7.html", "item5555", "tag"]
    pages = [(i, f"http://{rng.choice(['a.net', 'b.org'])}/" + "/".join(rng.choice(words) for _ in range(rng.randrange(6))) + rng.choice(["", "/", "?q=1", "#top"])) for i in range(1500)]
    labels = [(i, rng.random() < (0.9 if "/de" in u else 0.5 if "/12" in u else 0.05)) for i, u in pages if rng.random() < 0.8] + [(3, True), (4, None)]
    same_as_brute_tree(spark, pages, labels)


def test_url_filter_query(spark):
    """The registered query over whole tables against the plain-Python tree and rules."""
    sf = "/root/testdata/sf0.01"
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    labels = [(r["doc_id"], r["quality"] == 0 or r["toxic"] == 1) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    rows = {r["page_id"]: r for r in QUERIES["op4_url_filter"](spark, sf).collect()}
    assert rows.keys() == urls.keys()
    for i, r in rows.items():
        rest = urls[i].split("://", 1)[1]
        assert (r["host"], r["path"]) == (re.match(r"[^/?#]*", rest)[0].lower(), re.match(r"[^/?#]*([^?#]*)", rest)[1])
    tree = brute_tree([(i, r["host"], r["path"]) for i, r in rows.items()], labels)
    for i, r in rows.items():
        fits = [(len(h + p), h + p, kind) for kind, h, p in URL_RULES if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        assert (r["rule"], r["verdict"]) == (max(fits)[1:] if fits else (None, tree[i][1]))


# ---- 5 and 7


@pytest.mark.parametrize(("hot", "long"), [(5_000, 4 << 20), (1, 3000)])
def test_repeated_words(spark, monkeypatch, hot, long):
    from factspark.llm import superkmer

    monkeypatch.setattr(superkmer, "HOT", hot)
    monkeypatch.setattr(superkmer, "LONG_BYTES", long)
    texts = edge_texts(random.Random(1))
    first, expected = {}, {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) < i:
                gone[j : j + 50] = [True] * 50
        expected[i] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(docs_of(spark, texts)).collect()}
    assert got == expected and sum(x[1] for x in got.values()) > 400
    assert substring.remove_repeats(docs_of(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize(("hot", "long"), [(5_000, 4 << 20), (1, 500)])
def test_repeated_bytes(spark, monkeypatch, hot, long):
    from factspark.llm import superkmer

    monkeypatch.setattr(superkmer, "HOT", hot)
    monkeypatch.setattr(superkmer, "LONG_BYTES", long)
    texts = edge_texts(random.Random(2))
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - 99):
            if raw[j : j + 100] in seen:
                gone[j : j + 100] = b"\1" * 100
            seen.add(raw[j : j + 100])
        expected[i] = (len(raw), sum(gone), len(re.findall(b"\1+", gone)), sha(bytes(x for x, g in zip(raw, gone, strict=True) if not g)))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(docs_of(spark, texts)).collect()}
    assert got == expected and sum(x[1] for x in got.values()) > 2000


def test_transform_and_prefixes():
    rng = random.Random(3)
    for _ in range(150):
        strings = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 8))]
        first = np.cumsum([0, *map(len, strings)])
        rows = sorted((s[j:], i, j) for i, s in enumerate(strings) for j in range(len(s) + 1))  # ends rank by string, before all symbols
        transform, common = suffixes.transform_and_prefixes(strings)
        used = sorted({b for s in strings for b in s})
        assert transform.tolist() == [used.index(strings[i][j - 1]) + 1 if j else 0 for _, i, j in rows]
        shared = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert common.tolist() == [0, *(shared(x[0], y[0]) for x, y in zip(rows[:-1], rows[1:], strict=True))]
        assert suffixes.places_of_rows(transform, np.array([len(s) for s in strings])).tolist() == [int(first[i]) + j for _, i, j in rows]


def thue_morse(n, a, b):
    """n symbols and their complement: equal under every polynomial hash modulo a power of two from some length on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.mark.parametrize("n", [2048, 4096])
def test_no_collisions_of_patterns(spark, n):
    """Neither long words nor long runs of two words collide with their complements."""
    word, other = thue_morse(n, "a", "b")
    tail = " ".join(f"w{i}" for i in range(49))
    assert [r["n_removed"] for r in substring.remove_repeats(docs_of(spark, [f"{word} {tail}", f"{other} {tail}"])).collect()] == [0, 0]
    both = [x.replace("a", "x ").replace("b", "y ") for x in (word, other)]
    docs = docs_of(spark, [word, other, *both])
    assert all(r["kept"] for r in minhash.near_duplicates(docs_of(spark, [word, other])).collect())
    for op, size in ((substring, 50), (suffixes, 100)):
        cut = lambda t: t.encode().split() if size == 50 else t.encode()  # noqa: E731, B023
        texts, seen, gone = [word, other, *both], {}, {}
        for i, t in enumerate(texts):
            units = cut(t)
            flags = [False] * len(units)
            for j in range(len(units) - size + 1):
                w = tuple(units[j : j + size])
                if (seen.setdefault(w, i) < i) if size == 50 else (seen.setdefault(w, (i, j)) != (i, j)):
                    flags[j : j + size] = [True] * size
            gone[i] = sum(flags)
        assert {r["doc_id"]: r["n_removed"] for r in op.remove_repeats(docs).collect()} == gone


# ---- 6


def test_quality(spark):
    df = op6_quality_classifier(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    right = {k: np.mean([r["predicted"] == k for r in df if r["quality"] == k]) for k in (0, 1)}
    assert right[0] > 0.9 and right[1] > 0.97 and all(0 <= r["score"] <= 1 for r in df)


def brute_features(text):
    """The features of one text, byte by byte."""
    raw = text.encode()
    kinds = [quality.CLASSES[b] for b in raw]
    gap = [k in (quality._SPACE, quality._LINE) for k in kinds]
    start = [not g and (i == 0 or gap[i - 1]) for i, g in enumerate(gap)]
    ends = [i + 1 < len(raw) and not gap[i] and gap[i + 1] for i in range(len(raw))]
    n = lambda k: sum(x == k for x in kinds)
    some, words, letters = max(1, len(raw)), max(1, sum(start)), max(1, n(quality._LOWER) + n(quality._UPPER))
    twin = [i > 0 and raw[i] == raw[i - 1] for i in range(len(raw))]
    wide_upper = [i > 0 and raw[i - 1] == 0xC3 and 0x80 <= raw[i] < 0x9F for i in range(len(raw))]
    symbol = [k == quality._SYMBOL for k in kinds]
    split = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", raw) if w]
    both = lambda a, b: sum(x and y for x, y in zip(a, b, strict=True))
    capital = sum(s and (kinds[i] == quality._UPPER or (i + 1 < len(raw) and wide_upper[i + 1])) for i, s in enumerate(start))
    return [
        n(quality._UPPER) / letters, sum(wide_upper) / max(1, sum(b & 0xC0 == 0xC0 for b in raw)), n(quality._DIGIT) / some, n(quality._SYMBOL) / some, n(quality._STOP) / some,
        n(quality._CONTROL) / some, n(quality._WIDE) / some, both(twin, symbol) / words, both(ends, symbol) / words, both(ends, [k == quality._STOP for k in kinds]) / words,
        capital / words, np.log1p(words), np.log1p(len(raw) / words), np.log1p(n(quality._LINE)) / np.log1p(some), min(3, n(quality._SYMBOL) / words),
        raw.count(b"!") / words, raw.count(b"$") / words, raw.count(b"&") / words, sum(twin) / some, float(not raw), min(words, 10) / 10, (len(split) - len(set(split))) / max(1, len(split)),
    ]


def test_quality_query_against_a_plain_fit(spark):
    """The registered query's scores on whole tables: features byte by byte, and a fit of its own by plain gradient steps, rank the same."""
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    x = {i: np.array(brute_features(t)) for i, t in texts.items() if len(t) < 20_000}
    off = np.r_[0, np.cumsum([len(texts[i].encode()) for i in x])]
    assert np.allclose(quality.features(np.frombuffer("".join(texts[i] for i in x).encode(), np.uint8), off), np.stack(list(x.values())))
    known = [i for i in x if labels.get(i) in (0, 1)]
    z = np.stack([x[i] for i in known])
    mean, scale = z.mean(0), np.where(z.std(0) < 1e-9, 1, z.std(0))
    z, y = np.clip((z - mean) / scale, -6, 6), np.array([labels[i] for i in known])
    good, bad = z[y == 1], z[y == 0]
    w = np.zeros(z.shape[1])
    for step in range(600):  # every pair of a good and a bad text in turn, by shifting one list against the other
        diff = good - np.resize(np.roll(bad, step, 0), good.shape)
        w += 0.05 * (diff / (1 + np.exp(np.clip(diff @ w, -30, 30)))[:, None]).mean(0) - 0.05 * 1e-3 * w
    rows = {r["doc_id"]: r for r in op6_quality_classifier(spark, sf).collect()}
    assert rows.keys() == texts.keys() and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for i, r in rows.items())
    own = np.array([np.clip((x[i] - mean) / scale, -6, 6) @ w for i in x])
    theirs = np.array([rows[i]["score"] for i in x])
    place = lambda v: np.argsort(np.argsort(v))
    assert np.corrcoef(place(own), place(theirs))[0, 1] > 0.95


def test_quality_without_labels(spark):
    docs = docs_of(spark, edge_texts(random.Random(5)))
    none = spark.createDataFrame([(0, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_quality(docs, quality.fit_ranker(docs, none)).collect()} == {0.5}
    assert quality.keep_quality(docs, None).count() == docs.count() and quality.score_quality(docs.limit(0), None).count() == 0


# ---- 8


def test_near_duplicates(spark):
    rng = random.Random(6)
    base = [[f"t{rng.randrange(5000)}" for _ in range(rng.randrange(30, 200))] for _ in range(6)]
    texts = edge_texts(rng)
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(30)}"
        texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", (t or "").replace("İ", "").lower() if t is None or t.isascii() else t) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}
    kept = minhash.keep_first(docs_of(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(texts)) if find(i) == i] and kept.columns[0] == "doc_id"
    assert minhash.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


def test_sketch_is_full_and_estimates():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = h[:2000], h[500:2500]  # similarity 0.6
    s = minhash.sketches(np.r_[np.zeros(2000, np.int64), np.ones(2000, np.int64)], np.r_[a, b], 2, 128)
    assert (s != np.uint64(2**64 - 1)).all() and abs((s[0] == s[1]).mean() - 0.6) < 0.15
    one = minhash.sketches(np.zeros(1, np.int64), h[:1], 1, 128)
    assert (one != np.uint64(2**64 - 1)).all()


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 400), (400, 300), (7, 7)] + [(1000 + rng.randrange(50), 1000) for _ in range(80)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and got[500] == got[400] == got[300] == 300 and {v for k, v in got.items() if k >= 1000} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 9


def shingle_set(t):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", t) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    rows = op9_fingerprints(spark, SF).collect()
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect())
    order = sorted(texts, reverse=True)
    after = {d: order[(i + 1) % len(order)] for i, d in enumerate(order)}
    off, next_off, inside, by_text = [], [], [], defaultdict(set)
    for r in rows:
        t, nxt = texts[r["doc_id"]], texts[after[r["doc_id"]]]
        third = len(t) // 3
        new = t[: len(t) - third] + nxt[:third]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == sha(new)
        a, b, c = shingle_set(t), shingle_set(new), shingle_set(nxt)
        off.append(abs(r["near_edited"] - alike(a, b)))
        next_off.append(abs(r["near_next"] - alike(a, c)))
        if r["contained_in_edited"] is not None:
            inside.append(abs(r["contained_in_edited"] - len(a & b) / max(1, len(a))))
        if len(a) <= fingerprint.FLOOR and len(b) <= fingerprint.FLOOR:
            assert r["near_edited"] == pytest.approx(alike(a, b))
        by_text[t].add(r["fingerprint"])
        by_text[new].add(r["edited_fingerprint"])
    assert len(rows) == len(texts) and np.mean(off) < 0.03 and np.mean(next_off) < 0.02 and np.mean(inside) < 0.05 and len(inside) > 0.95 * len(rows)
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprint_containment_of_unequal_texts(spark):
    """A short text held whole in a long one, for many pairs: the share is 1, whatever the sizes."""
    rng = random.Random(11)
    pairs = []
    for i in range(40):
        short, filler = prose(rng, 40, 10**6), prose(rng, 4000 * (1 + i % 5), 10**6)
        pairs.append((short, filler + " " + short + " " + filler[::-1]))
    df = spark.createDataFrame(pairs, "a string, b string").select(*[fingerprint.sketch(fingerprint.shingle_hashes(F.col(c))).alias(c) for c in "ab"])
    got = df.select(fingerprint.containment(F.col("a"), F.col("b")).alias("ab"), fingerprint.containment(F.col("b"), F.col("a")).alias("ba"), F.size("a.kept").alias("n")).collect()
    assert all(r["ab"] == 1.0 for r in got) and all(r["ba"] < 0.05 for r in got) and all(r["n"] for r in got)


def test_next_document_for_any_ids(spark, monkeypatch):
    """One outlier, a third of the ids null and one id repeated: the order holds, and no bucket has more than its share."""
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 16)
    monkeypatch.setattr(fingerprint, "INTERVALS", 16)
    ids = [*range(900), 10**15, *[None] * 700, *[5] * 300]
    docs = spark.createDataFrame([(i, f"t{k} a b", "x", "y") for k, i in enumerate(ids)], "doc_id long, text string, bucket string, mark string")
    id_of = F.coalesce("doc_id", F.lit(-1))
    bucket = fingerprint.buckets(docs.select(id_of.alias("id")))
    assert docs.groupBy(bucket(id_of, F.xxhash64("text")).alias("b")).count().agg(F.max("count")).first()[0] <= 2 * len(ids) / 16
    mark = dict(docs.select("text", F.xxhash64("text")).collect())
    order = sorted(docs.collect(), key=lambda r: (1 if r["doc_id"] is None else -r["doc_id"], mark[r["text"]]))
    expected = {r["text"]: order[(i + 1) % len(order)]["text"] for i, r in enumerate(order)}
    out = fingerprint.with_next(docs, F.length).collect()
    assert {r["text"]: r["next_text"] for r in out} == expected and len(out) == len(ids) and all(r["next_own"] == len(r["next_text"]) for r in out)


def test_fingerprint_edges(spark):
    docs = spark.createDataFrame([(5, None), (9, ""), (7, "a b c"), (7, "a b c"), (None, "z"), (1000, "x " * 50), (1001, prose(random.Random(1), 30_000, 10**6))], "doc_id long, text string")
    out = fingerprint.fingerprints(docs).select("doc_id", fingerprint.likeness(F.col("own"), F.col("own")).alias("l"), fingerprint.containment(F.col("own"), fingerprint.merge(F.col("own"), F.col("next_sketch"))).alias("c")).collect()
    assert len(out) == 7 and {r["l"] for r in out} == {1.0} and {r["c"] for r in out} <= {1.0, None}
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0


# ---- 10


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    own = Tokenizer.from_file(path)
    rng = random.Random(8)
    alphabet = "ab  \n\t\r're 1290.,!é\u0085 ​ß中\U0001f600\x1c<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)] + ["a" * 3000, "<|endoftext|>", "x<|endoftext|> y", "", None, "don't"] + edge_texts(rng)
    coded = bpe.bpe_encode(docs_of(spark, texts), path, keep_ids=True)
    for r in coded.collect():
        ids = own.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(np.array(ids, "<u4").tobytes()) and r["decoded_sha256"] == sha(own.decode(ids, skip_special_tokens=False))
    rng = random.Random(12)
    long = ["ab" * 3000, "".join(rng.choice("abcdefgh") for _ in range(5000)), "a" * 2001, "\u00e9" * 1500, "".join(rng.choice("\u4e2d\u6587x") for _ in range(1200))]
    assert [c.tolist() for c in bpe.codec(path).encode_words([w.encode() for w in long])] == [own.encode(w, add_special_tokens=False).ids for w in long]
    back = {r["doc_id"]: r["text"] for r in bpe.bpe_decode(coded, path).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)} and bpe.bpe_encode(docs_of(spark, []), path).count() == 0
