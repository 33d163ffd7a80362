"""Operators across documents, pages and conversations against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quakeloom.llm import chat_format, components, decontamination, license_scans, simhash, url_filters, warc_fixity
from tests.llm.helpers import documents, empty, prose, texts

WORD = re.compile("[^\x20\x09-\x0d]+")


# ---- SimHash


def brute_fingerprint(text, k=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fingerprints, distance=4):
    ids = sorted(fingerprints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fingerprints[i] ^ fingerprints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def near_copies():
    rng = random.Random(11)
    out = list(texts()) + ["Alpha BETA", "alpha beta", "\x0b", None]
    base = prose(rng, 120).split()
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return list(enumerate(out))


def test_simhash(spark):
    rows = near_copies()
    expected = {i: brute_fingerprint(t) for i, t in rows}
    got = {r.doc_id: r for r in simhash.groups_of(simhash.fingerprinted(documents(spark, rows))).collect()}
    assert {i: r.fp % 2**64 for i, r in got.items()} == expected
    assert {i: r.component_id for i, r in got.items()} == brute_components(expected)


@pytest.mark.parametrize("groups", [5, 6, 8])
def test_links_on_dense_fingerprints(spark, groups):
    rng = random.Random(groups)
    centre = rng.getrandbits(64)
    found = {rng.getrandbits(64) for _ in range(200)} | {centre}
    for _ in range(300):
        x = centre
        for b in rng.sample(range(64), rng.randrange(1, 6)):
            x ^= 1 << b
        found.add(x)
    signed = {x - 2**64 if x >= 2**63 else x for x in found}
    links = {r.node: r.component for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), groups=groups).collect()}
    expected = brute_components({x: x % 2**64 for x in signed})
    assert {x: links.get(x, x) for x in signed} == expected


def test_simhash_awkward(spark):
    assert simhash.groups_of(simhash.fingerprinted(empty(spark))).count() == 0
    docs = documents(spark, [(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "x y z"), (9, None), (8, "")])
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.groups_of(simhash.fingerprinted(docs)).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (3, 3), (8, 8), (9, 8)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 8]


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (None, 1), (7, None), (3, 1), (3, 1), *((100 + i, 101 + i) for i in range(40)), *((500, 600 + i) for i in range(50))]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **{100 + i: 100 for i in range(41)}, 500: 500, **{600 + i: 500 for i in range(50)}}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---- decontamination


def brute_tiles(item, doc, least=5):
    """Greedy string tiling as it is defined: again and again the longest common run of unmarked tokens."""
    a, b = [False] * len(item), [False] * len(doc)
    total = 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return total
        k, i, j = best
        a[i : i + k], b[j : j + k] = [True] * k, [True] * k
        total += k


def tokens(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_tiling(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randrange(3, 50))) for i in range(8)] + [(8, None), (9, ""), (10, "again and again and again and again and again and")]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 4)):
            words = (items[rng.randrange(8)][1]).split()
            at = rng.randrange(len(words))
            parts += [" ".join(words[at : at + rng.randrange(2, 40)]).upper(), "again and " * rng.randrange(4)]
        rng.shuffle(parts)
        rows.append((i, " - ".join(parts)))
    rows += [(100, None), (101, ""), (102, items[3][1]), (103, " ".join(reversed([" ".join(items[4][1].split()[i : i + 8]) for i in range(0, 48, 8)])))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): (r.covered, r.n_tokens) for r in decontamination.contaminated(documents(spark, rows), bench).collect()}
    expected = {}
    for i, text in rows:
        for k, item in items:
            n = len(tokens(item))
            covered = brute_tiles(tokens(item), tokens(text)) if n >= 5 else 0
            if n and covered * 100 >= 50 * n:
                expected[i, k] = (covered, n)
    assert got == expected and any(i == 102 for i, _ in got)
    clean = decontamination.clean(documents(spark, rows), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in expected}
    assert clean.columns == documents(spark, rows).columns


@pytest.mark.parametrize("name, value", (("FILTER_BITS", 1 << 10), ("BROADCAST_TEXTS", 0), ("FILTER_BITS", 1 << 27)))
def test_seed_join(spark, monkeypatch, name, value):
    """The filter's size and the way of the join don't matter; repeated items and documents each count; any type of item_id."""
    rng = random.Random(4)
    items = [(i, prose(rng, 30)) for i in range(20)]
    bench = spark.createDataFrame(items + items[:2] + [(None, items[0][1])], "item_id int, text string")
    rows = [(i, prose(rng, 10) + " " + t) for i, t in items]
    docs = documents(spark, rows + rows[:3])
    monkeypatch.setattr(decontamination, name, value)
    got = decontamination.contaminated(docs, bench)
    assert dict(got.dtypes)["item_id"] == "int"
    assert sorted((r.doc_id, r.item_id) for r in got.where("item_id IS NOT NULL").collect()) == sorted([(i, i) for i, _ in rows] + [(0, 0), (1, 1)] + [(0, 0), (0, 0), (1, 1), (1, 1), (2, 2)])
    assert got.where("item_id IS NULL").count() == 2
    assert decontamination.clean(docs, bench).count() == 0


def test_common_seeds_alone_make_no_candidates(spark):
    """Seeds that most items share are left out, and a document that has no others isn't looked at."""
    rng = random.Random(6)
    phrase = prose(rng, 12)
    bench = spark.createDataFrame([(i, phrase + " " + prose(rng, 30)) for i in range(9)], "item long, text string")
    seeds = decontamination.item_seeds(bench)
    rare = decontamination.rare_seeds(seeds)
    common = seeds.groupBy("seed").count().where("count = 9")
    assert common.count() == len(tokens(phrase)) - 4 and rare.join(common, "seed").count() == 0 and rare.count() > 0


def test_decontamination_awkward(spark):
    bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert decontamination.contaminated(documents(spark), bench).count() == 0
    assert decontamination.contaminated(empty(spark), bench.limit(0)).count() == 0
    assert decontamination.clean(documents(spark), bench).count() == len(texts())


# ---- URL filters


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "rule": F.lit(1), "trust": F.lit(2)})


def test_rules(spark):
    rows = [
        (1, "http://WWW.Example.COM/en/x?q#f", ""), (2, "https://a.example.com/en/", ""), (3, "https://example.com/fr/", ""), (4, "ftp://x.net/es/1", ""), (5, "http://x.net/en/", ""),
        (6, None, None), (7, "no scheme", None), (8, "http://badexample.com", None), (9, "http://net?x=/fr/", ""), (10, "http://y.org/fr/#/es/", ""), (10, "http://y.org/fr/#/es/", ""),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages(spark, rows)).collect()}
    assert got == {
        1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/", "example.com/en/", "block"), 3: ("example.com", "/fr/", "com/", "allow"),
        4: ("x.net", "/es/1", "net/es/", "block"), 5: ("x.net", "/en/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("badexample.com", "", None, "allow"), 9: ("net", "", None, "allow"), 10: ("y.org", "/fr/", None, "allow"),
    }
    assert url_filters.judge(pages(spark, rows)).count() == 11 and url_filters.judge(pages(spark, [])).count() == 0


def test_trust_flows_along_links_and_distrust_against_them(spark):
    link = lambda *urls: "".join(f'<A class=x HREF="{u}">y</a>' for u in urls)
    rows = [(1, "http://good.com/", link("http://friend.org/a", "//friend.org/b", "/self")), (2, "http://friend.org/", link("https://second.org")), (3, "http://second.org/", ""),
            (4, "http://bad.net/es/", ""), (5, "http://farm.org/", link("http://bad.net/x")), (6, "http://outer.org/x", link("http://farm.org/")), (7, "http://alone.org/x", None)]
    got = {r.page_id: r for r in url_filters.judge(pages(spark, rows)).collect()}
    assert [got[i].verdict for i in range(1, 8)] == ["allow", "allow", "allow", "block", "block", "block", "allow"]
    assert got[2].trust > got[3].trust > 0 == got[3].distrust and got[5].distrust > got[6].distrust > 0 == got[6].trust


def test_propagation_equals_matrix_powers(spark):
    rng = random.Random(6)
    hosts = [f"h{i}" for i in range(12)]
    edges = {(a, b) for a in hosts for b in hosts if a != b and rng.random() < 0.25}
    good = {h: int(i < 3) for i, h in enumerate(hosts)}
    flow = url_filters.Flow()
    got = {r.host: (r.trust, r.distrust) for r in url_filters.propagate(spark.createDataFrame([(h, good[h], 1 - good[h]) for h in hosts], "host string, good int, bad int"), spark.createDataFrame(sorted(edges), "src string, dst string"), flow).collect()}
    outs = {h: sum(a == h for a, _ in edges) for h in hosts}
    ins = {h: sum(b == h for _, b in edges) for h in hosts}
    new = {h: (good[h] * (flow.mass // 3 * 15 // 100), (1 - good[h]) * (flow.mass // 9 * 15 // 100)) for h in hosts}
    total, rounds = dict(new), 0
    while sum(map(sum, new.values())) > flow.settled:
        trust = {h: sum(new[a][0] * 85 // (100 * outs[a]) for a, b in edges if b == h) for h in hosts}
        new = {h: (trust[h], sum(new[b][1] * 85 // (100 * ins[b]) for a, b in edges if a == h)) for h in hosts}
        total, rounds = {h: (total[h][0] + new[h][0], total[h][1] + new[h][1]) for h in hosts}, rounds + 1
    whole = [sum(t[i] for t in total.values()) for i in (0, 1)]
    assert got == {h: tuple(t[i] * flow.mass // whole[i] for i in (0, 1)) for h, t in total.items()}
    assert rounds <= flow.rounds

    # the stationary distribution of walks that start anew at the seeds, also from hosts without links
    want = np.array([good[h] / 3 for h in hosts])
    start = want
    for _ in range(400):
        flowed = np.array([sum(want[hosts.index(a)] / outs[a] for a, b in edges if b == h) for h in hosts])
        loose = sum(want[i] for i, h in enumerate(hosts) if not outs[h])
        want = 0.15 * start + 0.85 * (flowed + loose * start)
    assert sum(abs(got[h][0] / flow.mass - want[i]) for i, h in enumerate(hosts)) < 0.02


def test_an_unrelated_link_does_not_change_scores(spark):
    seeds = spark.createDataFrame([("a", 1, 0), ("b", 0, 1), ("c", 0, 0), ("d", 0, 0)], "host string, good int, bad int")
    flow = url_filters.Flow()
    for edges in ([], [("c", "d")]):
        got = {tuple(r) for r in url_filters.propagate(seeds, spark.createDataFrame(edges, "src string, dst string"), flow).collect()}
        assert got == {("a", flow.mass, 0), ("b", 0, flow.mass)}


# ---- chat formatting


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))


def test_round_trip(spark):
    nasty = ["<|turn|>user\nx<|end|>", "~0~1~2 ~", "", None, "a\nb", r"\### Assistant: </turn> ok", "<", "~<~1", "é" * 5000]
    rows = [(c, t, "assistant" if (c + t) % 2 else random.Random(t).choice(["user", "sys\ntem", None, "<r>"]), nasty[(c + t) % len(nasty)]) for c in range(9) for t in range(5)]
    rows += [(None, 1, "user", "x"), (50, None, "user", "first"), (50, 1, "b", "y"), (50, 1, "a", "z"), (51, 1, "user", "twice"), (51, 1, "user", "twice")]
    done = chat_format.canonical_table(conversations(spark, rows)).select("conv_id", "turns", chat_format.formatted(F.col("turns")).alias("s"))
    done = done.select("conv_id", "turns", chat_format.read_back(chat_format.rendered(F.col("s"))).alias("back"), chat_format.loss_text(F.col("s")).alias("loss"))
    got = {r.conv_id: r for r in done.collect()}
    for c in {r[0] for r in rows}:
        turns = [(role or "", text or "") for _, role, text in sorted(((t is not None, t), role or "", text or "") for i, t, role, text in rows if i == c)]
        assert [tuple(t) for t in got[c].turns] == turns == [tuple(t) for t in got[c].back]
        assert got[c].loss == "".join(text for role, text in turns if role == "assistant")
    assert chat_format.canonical_table(conversations(spark, [])).count() == 0


def test_layouts(spark):
    rows = [
        ('{"prompt": "p", "response": "r"}', "prompt", [("user", "p"), ("assistant", "r")]),
        ('{"output": "o", "instruction": "i", "input": "n"}', "instruction_input", [("user", "i\nn"), ("assistant", "o")]),
        ('{"instruction": "i", "input": "", "output": 5}', "instruction_input", [("user", "i"), ("assistant", "5")]),
        ('{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": null}]}', "messages", [("system", "s"), ("user", "")]),
        ('{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}', "from_value", [("user", "h"), ("assistant", "g")]),
        ('{"other": 1}', None, None), ("not json", None, None), ("", None, None), (None, None, None),
    ]
    df = spark.createDataFrame([(i, p, 0) for i, (p, _, _) in enumerate(rows)], "id int, payload string, turns int").drop("turns")
    got = {r.id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat_format.canonical_payloads(df).collect()}
    assert got == {i: (layout, turns) for i, (_, layout, turns) in enumerate(rows)}


def test_table_layouts(spark):
    df = conversations(spark, [(1, 0, "user", "a")])
    same = df.select(F.col("conv_id").alias("dialog_id"), F.col("turn").alias("index"), F.col("role").alias("speaker"), F.col("text").alias("utterance"))
    assert chat_format.canonical_table(same).collect() == chat_format.canonical_table(df).collect()
    with pytest.raises(ValueError, match="no mapping"):
        chat_format.canonical_table(df.select("conv_id"))


# ---- fixity


def test_audit(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}é</p>" * (i % 5)) for i in range(1000)] + [(None, None, None), (5000, "", "last")]
    a = pages(spark, rows)
    changed = [(i, u, h + "!" if i in (17, 999) else h) for i, u, h in rows if i != 300] + [(20000, "new", "")]
    got = {(r.number, r.status) for r in warc_fixity.audit(a, pages(spark, changed)).collect()}
    assert got == {(17, "changed"), (999, "changed"), (300, "missing"), (20000, "extra")}
    assert warc_fixity.audit(a, a).count() == 0
    assert warc_fixity.audit(a, a.limit(0)).count() == 1002 == warc_fixity.audit(a.limit(0), a).count()
    assert warc_fixity.audit(a.limit(0), a.limit(0)).count() == 0


def test_audit_tells_null_from_minus_one_and_finds_offsets(spark):
    rows = [(None, "u", "x"), (-1, "v", "y"), (4, "w", "é" * 10**6), (7, "w", "z"), (4097, "t", "")]
    a = pages(spark, rows)
    assert [(r.number, r.status) for r in warc_fixity.audit(a, pages(spark, rows[1:])).collect()] == [(None, "missing")]
    assert [(r.number, r.status) for r in warc_fixity.audit(a, pages(spark, [(None, "u", "!")] + rows[1:])).collect()] == [(None, "changed")]
    size = {r.number: r.n_bytes for r in warc_fixity.record_digests(a).collect()}
    got = {r.number: (r.file, r.offset, r.offset_b, r.status) for r in warc_fixity.audit(a, pages(spark, rows[:2] + [(7, "w", "q"), (4097, "t", "s")])).collect()}
    assert got == {4: (0, 0, None, "missing"), 7: (0, size[4], 0, "changed"), 4097: (1, 0, 0, "changed")}


def test_repeated_records(spark):
    twice = pages(spark, [(1, "u", "x"), (1, "u", "y"), (2, "u", "z")])
    assert warc_fixity.audit(twice, pages(spark, [(1, "u", "y"), (2, "u", "z"), (1, "u", "x")])).count() == 0
    assert [r.number for r in warc_fixity.audit(twice, pages(spark, [(1, "u", "y"), (1, "u", "y"), (2, "u", "z")])).collect()] == [1]


def test_record_bytes_and_files(spark, tmp_path):
    df = pages(spark, [(1, "http://a/", "<p>é\r\n\r\n</p>"), (2, None, None), (None, "http://b/", "line\nline")])
    record = df.where("page_id = 1").select(warc_fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))).first()[0]
    body = "<p>é\r\n\r\n</p>".encode()
    assert bytes(record).endswith(b"Content-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")
    digest = warc_fixity.record_digests(df).where("number = 1").first().digest
    assert digest == hashlib.sha256(bytes(record)).hexdigest()
    warc_fixity.write_warc(df, str(tmp_path / "w"))
    got = {r.page_id: (r.url, r.html, r.whole) for r in warc_fixity.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {1: ("http://a/", "<p>é\r\n\r\n</p>", True), 2: ("", "", True), None: ("http://b/", "line\nline", True)}


# ---- licenses


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/LICENSE", mit), (2, "a/x.txt", "no header"), (3, "a/b/c/y.txt", "text. " + gpl + " more"), (4, "a/b/c/z.txt", None), (5, "q/z.txt", ""), (6, None, "a license plate"),
            (7, "a/b/COPYING", gpl), (8, "a/b/d/e/f.txt", "x"), (9, "r/f.txt", "line\n" + mit + "\n" + gpl), (10, "ab/f.txt", "x"), (10, "ab/f.txt", "x"), (11, "top.txt", "licensed under the apache license, version 2.0")]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({"license": F.lit(1), "dir": F.lit(2), "own": F.lit(3)})
    got = {r.doc_id: (r.license, r.how) for r in license_scans.scan(files).collect()}
    assert got == {1: ("MIT", "header"), 2: ("MIT", "inherited"), 3: ("GPL-3.0", "header"), 4: ("GPL-3.0", "inherited"), 5: (None, None), 6: (None, None), 7: ("GPL-3.0", "header"),
                   8: ("GPL-3.0", "inherited"), 9: ("GPL-3.0", "header"), 10: (None, None), 11: ("Apache-2.0", "header")}
    assert license_scans.scan(files).count() == len(rows) and license_scans.scan(files.limit(0)).count() == 0


def test_root_license_reaches_all(spark):
    files = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License."), (2, "a/b/c.txt", "x"), (3, None, "y")], "doc_id long, path string, text string")
    assert {r.doc_id: r.license for r in license_scans.scan(files).collect()} == {1: "MIT", 2: "MIT", 3: "MIT"}
