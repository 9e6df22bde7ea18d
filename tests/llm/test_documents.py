"""SimHash, line dedup, packing, licences, token counts, decontamination and quality against brute force."""

import heapq
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import decontam, license_scan, line_dedup, packing, quality, queries, shared, simhash, unigram_count
from corpusloom.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, fp long, key_ string, lines_ int, ids string, p_ge_2 string"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta", "en"),
    (2, "alpha BETA gamma\tdelta epsilon\nzeta eta theta", None),
    (3, None, "en"),
    (4, "", "en"),
    (5, "a b", "en"),
    (6, "A  b ", "en"),
    (7, LONG, "en"),
    (8, "Alpha beta gamma delta epsilon zeta eta theta", "en"),
    (8, "Alpha beta gamma delta epsilon zeta eta theta", "en"),
    (9, "x\ny\nz\nx\ny\nz\nx\ny", "en"),
    (10, "0\nx\ny\nz\n1\n\n\n\n\n", "en"),
    (11, " \n\t", "en"),
    (None, "x\ny\nz", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 5, "k", 2, "i", "p") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def labels_of(n, pairs):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(0, i) for i in range(280, 300)] + [(i, i + 1) for i in range(400, 520)]
    want = labels_of(600, edges)
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert shared.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def brute_fingerprint(text, size=4, bits=64):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    digest = xxhash.xxh64_intdigest if bits == 64 else xxhash.xxh3_128_intdigest
    hashes = [digest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(bits) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_anchors(fp, scheme):
    """The anchors of a fingerprint: code words of each part (those with the exclusive-or of their set places among the first 2^r - 1 zero) within two bits."""
    out = set()
    for number, spans in enumerate(scheme.parts):
        part = width = 0
        for word, first, bits in spans:
            part |= (fp >> 64 * word + first & (1 << bits) - 1) << width
            width += bits
        length = max(n for n in (1, 3, 7, 15, 31) if n <= width)
        for flips in [(), *((i,) for i in range(width)), *((i, j) for i in range(width) for j in range(i))]:
            word = part
            for i in flips:
                word ^= 1 << i
            check = 0
            for i in range(length):
                check ^= i + 1 if word >> i & 1 else 0
            if not check:
                out.add((number, word))
    return out


def brute_links(fps, scheme):
    """Pairs of places in ``fps`` that link under ``scheme``; exact schemes link by distance alone."""
    exact = scheme.max_bits <= 3 * len(scheme.parts) - 1
    reach = [set() if exact else brute_anchors(f, scheme) for f in fps]
    return [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= scheme.max_bits and (exact or fps[i] == fps[j] or reach[i] & reach[j])]


def nodes_of(spark, fps, scheme):
    words = [tuple(int(np.array(f >> 64 * k & (1 << 64) - 1, np.uint64).view(np.int64)) for k in range(len(scheme.words))) for f in fps]
    return spark.createDataFrame([(i, *w) for i, w in enumerate(words)], ["node", *scheme.words])


def near_copies(rng, bits, centres, each, flips):
    fps = set()
    for _ in range(centres):
        x = rng.getrandbits(bits)
        fps.add(x)
        for _ in range(each):
            y = x
            for _ in range(rng.randrange(flips)):
                y ^= 1 << rng.randrange(bits)
            fps.add(y)
    return sorted(fps)


@pytest.mark.parametrize("scheme", [simhash.EXACT, simhash.SIMILAR])
@pytest.mark.parametrize("cell", [simhash.CELL, 3])
def test_anchors_miss_no_link(spark, scheme, cell):
    fps = near_copies(random.Random(1), scheme.bits, 60, 7, 7 if scheme is simhash.EXACT else 24)
    links = brute_links(fps, scheme)
    want = labels_of(len(fps), links)
    got = {r.node: r.component for r in simhash.linked(nodes_of(spark, fps, scheme), scheme, cell).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == want and len(links) > 200


def test_spanning_links():
    rng = random.Random(5)
    fps = near_copies(rng, 64, 40, 20, 8)
    words = np.array(fps, np.uint64)[:, None]
    got = list(simhash.spanning(words, 4))
    assert labels_of(len(fps), got) == labels_of(len(fps), brute_links(fps, simhash.EXACT)) and len(got) < len(fps)


def test_many_near_copies_of_one_text(spark):
    """20,000 different near copies: what is written stays in proportion to the rows, and the groups are right."""
    fps = near_copies(random.Random(9), 64, 1, 29_000, 9)
    assert len(fps) > 20_000
    rows = []

    def seen(edges, *args, **kwargs):
        rows.append(edges.count())
        return components(edges, *args, **kwargs)

    components = simhash.components
    simhash.components = seen
    try:
        got = {r.node: r.component for r in simhash.linked(nodes_of(spark, fps, simhash.EXACT)).collect()}
    finally:
        simhash.components = components
    arr = np.array(fps, np.uint64)[:, None]
    want = labels_of(len(fps), simhash.spanning(arr, 4))
    assert [got.get(i, i) for i in range(len(fps))] == want
    assert max(rows) < 33 * len(fps)


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    text = {}
    for r in ROWS:
        text[r[0]] = r[1]
    for r in got:
        assert r.fingerprint == f"{brute_fingerprint(text[r.doc_id]):016x}"
    group = {r.doc_id: r.component_id for r in got}
    assert group[2] == group[8] == 1 and group[4] == group[11] == 3 and group[6] == 5 and group[7] == 7
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 5, 7, 9, 10, None], key=str)


def test_simhash_on_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = labels_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows)).collect()}
    assert all(got[r.doc_id].component_id == rows[want[i]].doc_id and got[r.doc_id].fingerprint == f"{fps[i]:016x}" for i, r in enumerate(rows))


def brute_lines(rows):
    seen, out = set(), {}
    for key, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        lines = None if text is None else text.split("\n")
        gone = set()
        for i in range(len(lines or []) - 2):
            window = tuple(lines[i : i + 3])
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(window)
        out[key] = (None if lines is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def test_line_dedup(spark, docs, none):
    rows = [r[:2] for r in dict.fromkeys(ROWS)]
    unique = docs.dropDuplicates(["doc_id"])
    got = line_dedup.dedup_lines(unique)
    assert got.columns == [*docs.columns, "n_removed"]
    want = brute_lines(rows)
    for r in got.collect():
        assert (r.text, r.n_removed) == (want[r.doc_id] if r.doc_id is not None else ("x\ny\nz", 0))
    assert line_dedup.dedup_lines(none).count() == 0
    real = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_lines([(r.doc_id, r.text) for r in real.collect()])
    assert {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(real).collect()} == want
    plan = line_dedup.dedup_lines(real)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_has_no_quadratic_texts(spark):
    text = "\n".join(str(i % 50_000) for i in range(100_000))
    r = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_removed == 50_000 and r.text.count("\n") == 49_999


def check_pieces(pieces, texts, tokenizer):
    by_doc, by_sequence = {}, {}
    for r in pieces:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length
        by_doc.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    for doc, text in texts.items():
        parts = sorted(by_doc[doc])
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert [i for _, ids, _ in parts for i in ids] == want and all(p[2] == len(want) for p in parts)
    total = sum(length for parts in by_sequence.values() for _, length in parts)
    padded = sum(n if n & (n - 1) == 0 else 2048 for n in (sum(x[1] for x in p) for p in by_sequence.values()))
    assert padded == total


def test_packing(spark, docs, none):
    path = tokenizer_file("word_bpe_49k.json")
    coder = packing.WordEncoder(path)
    assert coder.direct and coder.lowers and coder.parts
    rows = {r[0]: r[1] for r in ROWS if r[0] != 8}
    rows |= {100: "A<|ENDOFTEXT|>b <|endoftext|>.", 101: "É. É, x., a.\" don't, it's. 3, 4. ,. \x1c!a", 102: "  a b.　c İK. ΑΣ."}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    check_pieces(packing.pack(df, path).collect(), rows, coder.tokenizer)
    real = spark.read.parquet(f"{SF}/documents.parquet")
    check_pieces(packing.pack(real, path).collect(), {r.doc_id: r.text for r in real.collect()}, coder.tokenizer)
    assert packing.pack(none, path).count() == 0
    assert packing.pack(docs, path).where("doc_id = 8").count() >= 2


@pytest.mark.parametrize("small", [False, True])
def test_encoding_of_words_with_signs_and_capitals(monkeypatch, small):
    if small:  # portions, generations and gathered runs of a few words
        for name, n in (("_ROWS", 3), ("_BYTES", 200), ("_WORDS", 5), ("_MEMO", 20)):
            monkeypatch.setattr(packing, name, n)
    coder, rng = packing.WordEncoder(tokenizer_file("word_bpe_49k.json")), random.Random(3)
    parts = ["the", "q", "École", "éçà", "É", "ÀÞØ", "ß", "×", "÷", "ÿ", "THE", "it's", "don't", "e\u0301", "\u0301", "ΑΣ", "İ", "中文", "12", "²", ".", ",", "***", "=", "|", "'", "<|endoftext|>", "<|ENDOFTEXT|>", "|>", " ", "\n", "\t\x0b", "\x1c", "\xa0", "x" * 60]
    texts = [None, "", "  ", *("".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(300))]
    column = pa.array(texts, pa.string())
    got = [x for at, n in packing.portions(column) for x in coder.encode(column.slice(at, n))]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    asked, ids = [], coder._ids
    monkeypatch.setattr(coder, "_ids", lambda words: (asked.extend(words), ids(words))[1])
    heads = ["".join(rng.choices("abcdeéèç", k=9)) for _ in range(500)]
    coder.encode(pa.array([" ".join(h.capitalize() + rng.choice(["", ".", ",***", "&&&"]) for h in heads)]))
    assert set(asked) <= {".", ",***", "&&&"}  # all else goes to the model without the tokenizer's other steps


def test_assignment_of_what_fits_nowhere_takes_few_steps(monkeypatch):
    pops, pop = [], heapq.heappop
    monkeypatch.setattr(packing.heapq, "heappop", lambda heap: (pops.append(1), pop(heap))[1])
    pieces = packing.assign([1500] * 2000)
    assert sum(p[2] for p in pieces) == 1500 * 2000 and len(pops) < 10_000


@pytest.mark.parametrize("seed", range(20))
def test_assignment(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 5, 700, 1500, 2047, 2048, 2049, 9000]) + rng.randrange(3) for _ in range(rng.randrange(1, 300))]
    pieces = packing.assign(lengths)
    covered, used = {}, {}
    for d, start, n, sequence, offset in pieces:
        covered.setdefault(d, []).append((start, n))
        used.setdefault(sequence, []).append((offset, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, size in sorted(covered[d]):
            assert start == at and size > 0
            at += size
        assert at == n
    for parts in used.values():
        assert sum(n for _, n in parts) == max(o + n for o, n in parts) <= 2048
    assert sorted(used) == list(range(len(used)))


def test_license(spark, docs, none):
    texts = {
        1: "Released under the MIT License. mit LICENSE; Apache-License",
        2: "This work is licensed under the GNU General Public License, version 3.",
        3: "Licensed under the Apache License, Version 2.0.",
        4: "Licensed under CC BY-NC 4.0.",
        5: "permission is granted by the emit license",
        6: "Permission is hereby granted, free of charge, to any person obtaining a copy of this lovely software and files (the “Software”)",
    }
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (9, 3, 3, 7, "apache,mit", "apache,mit,mit-notice")
    assert got[2].labels == "gpl,gpl-notice" and got[2].score == 9 / 12 and got[3].labels == "apache,apache-2.0-notice" and got[4].labels == "cc-by-nc-4.0-notice"
    assert (got[5].labels, got[5].first_word, got[5].score) == ("", None, 0.0) and got[6].labels == ""
    full = license_scan.TEMPLATES["mit-text"].replace("<<var 12>>", "software and associated documentation files").replace("<<optional>>", "").replace("<<end>>", "")
    full = full.split("THE SOFTWARE IS")[0]
    assert license_scan.Scanner({}, license_scan.TEMPLATES).scan(full)[5:7] == ("mit-text", 1.0)
    assert license_scan.Scanner({}, license_scan.TEMPLATES).scan(full.replace("hereby", "gladly"))[5] == ""
    assert license_scan.scan(docs).count() == len(ROWS) and license_scan.scan(none).count() == 0
    null = license_scan.scan(docs).where("doc_id = 3").first()
    assert (null.n_words, null.n_base, null.labels, null.score) == (0, 0, "", 0.0)


def expression(template):
    """A template as a regular expression over words that each end in a space."""
    out = ""
    for part in re.split("(<<.*?>>)", template):
        if part.startswith("<<var"):
            out += r"(?:\S+ ){0,%s}" % part[6:-2]
        elif part.startswith("<<"):
            out += "(?:" if part == "<<optional>>" else ")?"
        else:
            out += "".join(re.escape(w.decode()) + " " for w in license_scan.words_of(part))
    return re.compile(r"(?<!\S)" + out)


def some_wording(template, rng):
    """A text that a template accepts, with optional and replaceable regions drawn."""
    while "<<optional>>" in template:
        template = re.sub("<<optional>>((?:(?!<<optional>>|<<end>>).)*)<<end>>", lambda m: m[1] if rng.random() < 0.5 else "", template, flags=re.S)
    return re.sub(r"<<var (\d+)>>", lambda m: " ".join(rng.choice(["owner", "the", "and"]) for _ in range(rng.randrange(int(m[1]) + 1))), template)


def test_templates_against_expressions():
    rng = random.Random(2)
    scanner = license_scan.Scanner({}, license_scan.TEMPLATES)
    expressions = {label: expression(t) for label, t in license_scan.TEMPLATES.items()}
    assert len(expressions) >= 20
    matched = 0
    for label, template in license_scan.TEMPLATES.items():
        for k in range(12):
            text = f"Before it. # {some_wording(template, rng)} and after"
            words = text.split()
            if k % 3 == 0:  # one word is changed, dropped or put in
                i = rng.randrange(len(words))
                words[i : i + 1] = rng.choice([[], ["other"], [words[i], "other"]])
            text = " ".join(words)
            joined = "".join(w.decode() + " " for w in license_scan.words_of(text))
            want = {other for other, e in expressions.items() if e.search(joined)}
            assert set(filter(None, scanner.scan(text)[5].split(","))) == want
            matched += label in want
    assert matched > 8 * len(expressions)


def test_license_base_against_brute_force(spark):
    """The query's columns over whole documents, from a plain reading of the words."""
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = 0
    for r in queries.op4_license(spark, SF).collect():
        low = "".join(c.lower() if c.isascii() else c for c in docs[r.doc_id] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places})) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1
        found += len(places)
    assert found > 0


def test_automaton_equals_expansion():
    a = license_scan.compile_template("x <<optional>>y <<optional>>z<<end>><<end>> <<var 2>> w")
    accepted = {"x w", "x y w", "x y z w", "x q w", "x q r w", "x y q r w", "x y z q r w"}
    for text in [*accepted, "x q r s w", "y w", "x", "x z z z w"]:
        words = text.encode().split()
        assert (a.longest(words, 0) == len(words)) == (text in accepted), text


def test_token_count(spark, docs, none):
    from tokenizers import Tokenizer, models, normalizers

    path = tokenizer_file("piece_bpe_32k.model")
    vocabulary = unigram_count.load_vocabulary(path)
    library = Tokenizer(models.Unigram(vocabulary, 0, True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    want = lambda t: len(library.encode(t, add_special_tokens=False).ids) if t else 0
    got = unigram_count.count_tokens(docs, path).collect()
    text = {r[0]: r[1] for r in ROWS}
    assert len(got) == len(ROWS) and all(r.n_tokens == want(text[r.doc_id]) for r in got)
    counter = unigram_count.Counter(vocabulary)
    for t in ["日本語 テスト\n\n☃☃ <s> x", "   ", "é€\U0001f600", "x" * 5000]:
        assert counter.count(t)[1] == want(t)
    assert unigram_count.count_tokens(none, path).count() == 0


def test_token_count_ties():
    from tokenizers import Tokenizer, models, normalizers

    vocabulary = [("<unk>", 0.0), ("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("aba", -6.0), ("ba", -4.0), ("▁a", -5.0), ("▁ab▁", -7.0)]
    library = Tokenizer(models.Unigram(vocabulary, 0, False))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    counter = unigram_count.Counter(vocabulary)
    rng = random.Random(0)
    for _ in range(500):
        t = "".join(rng.choice("aab cd") for _ in range(rng.randrange(1, 14)))
        assert counter.count(t)[1] == len(library.encode(t, add_special_tokens=False).ids), t


def brute_hits(text, items):
    words, out = decontam.words_of(text), {}
    for item, sample in items:
        want = decontam.words_of(sample)
        row = list(range(len(want) + 1))
        best = row[-1]
        for w in words:
            new = [0]
            for i, x in enumerate(want, 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != w)))
            row = new
            best = min(best, row[-1])
        if want and best <= len(want) // 5:
            out[item] = best
    return out


def test_decontamination_finds_planted_edits(spark):
    rng = random.Random(7)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "five words make an item"), (901, "too few"), (902, None), (903, "")]
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows = []
    for k, t in enumerate(texts * 3):
        words, (_, sample) = t.split(), items[k % 40]
        part = sample.upper().split()
        for _ in range(k % 3 * len(part) // 12):
            i = rng.randrange(len(part))
            part[i : i + 1] = rng.choice([[], ["zz"], [part[i], "yy"]])
        at = rng.randrange(len(words) + 1)
        rows.append((k, " ".join(words[:at] + part + words[at:])))
    rows += [(1000, None), (1001, ""), (1002, "x Five words, make an ITEM!"), (1002, "x Five words, make an ITEM!"), (None, "five words make an item")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontam.contaminated(df, bench).collect()
    found = {(r.doc_id, r.item_id): r.distance for r in got}
    want = {(k, i): d for k, t in rows for i, d in brute_hits(t, items).items()}
    assert found.items() <= want.items()
    assert {k for k, d in want.items() if d == 0} <= found.keys() and len(found) >= 0.95 * len(want)
    assert sum(r.doc_id == 1002 for r in got) == 2
    clean = decontam.keep_clean(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {k for k, _ in rows} - {k for k, _ in found}
    assert decontam.contaminated(df.where("false"), bench).count() == 0 and decontam.contaminated(df, bench.where("false")).count() == 0
    assert decontam.keep_clean(df, bench.where("false")).count() == len(rows)


@pytest.mark.parametrize("n", [5, 7, 9, 10, 14, 15, 29, 59, 80, 119, 200, 240])
def test_decontamination_recall_at_the_limit(n):
    rng = random.Random(n)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(n))) for i in range(60)]
    texts = []
    for k, (_, sample) in enumerate(items):
        part = sample.split()
        edits = n // 5
        places = sorted(rng.sample(range(n), edits)) if k % 2 else [(2 * i + 1) * n // (2 * edits) for i in range(edits)]
        for i in reversed(places):
            part[i : i + 1] = rng.choice([[], ["zz"], [part[i], "yy"]])
        around = [f"w{rng.randrange(5000)}" for _ in range(60)]
        texts.append(" ".join([*around[: rng.randrange(40)], *part, *around[40:]]))
    got = decontam.Index(items).hits(texts)
    want = [brute_hits(t, items) for t in texts]
    assert all({i: d for i, d, _, _ in own}.items() <= all_.items() for own, all_ in zip(got, want, strict=True))
    assert sum(i in {x[0] for x in own} for i, own in enumerate(got)) >= 0.95 * len(items)


def test_decontamination_of_short_and_unspaced_items():
    words = "one two three four five six seven eight nine ten".split()
    items = [(n, " ".join(words[:n])) for n in range(1, 5)] + [(7, "same same same same"), (8, "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed"), (9, "...")]
    texts = ["zero one", "ONE, two!", "one three", "x one two three four y", "same same same", "a same same same same b", "\u4ed6\u8bf4\u4eca\u5929\u5929\u6c14\u4e0d\u597d\u6211\u4eec\u53bb\u516c\u56ed\u3002", "", None]
    got = decontam.Index(items).hits(texts)
    assert [{i: d for i, d, _, _ in own} for own in got] == [brute_hits(t, items) for t in texts]
    assert [sorted(x[0] for x in own) for own in got] == [[1], [1, 2], [1], [1, 2, 3, 4], [], [7], [8], [], []]


def test_decontamination_of_texts_that_repeat_themselves():
    rng = random.Random(11)
    items = [(i, " ".join(rng.choice("abc"[: 1 + i % 3]) for _ in range(rng.randrange(5, 70)))) for i in range(24)] + [(50, "0 " * 100), (51, "0 " * 100), (52, "x y " * 30)]
    texts = [" ".join(rng.choice("abc0xy"[: 1 + k % 6]) for _ in range(rng.randrange(1, 200))) for k in range(60)] + ["x y " * 200, "0 " * 85, "0 " * 300 + "b " * 20]
    index = decontam.Index(items)
    got, want = index.hits(texts), [brute_hits(t, items) for t in texts]
    # Random letters are no spread edits, so only what is found is checked in full, and exact copies and plain rows for being found.
    for own, all_ in zip(got, want, strict=True):
        found = {i: d for i, d, _, _ in own}
        assert found.items() <= all_.items() and {i for i, d in all_.items() if d == 0} <= set(found)
    assert {50, 51} <= {x[0] for x in got[-1]} and 52 in {x[0] for x in got[-3]}
    tracemalloc.start()
    assert sorted(x[:2] for x in index.hits(["0 " * 500_000])[0] if x[0] >= 50) == [(50, 0), (51, 0)]
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 1200)
    bench, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("benchmark", "documents"))
    assert len(list(decontam.indexes(bench))) > 3
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert got == {(r.doc_id, i) for r in docs.collect() for i, t in items if t in r.text}


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 3 != 0")
    got = {r.doc_id: r for r in quality.classify(docs.select("doc_id", "text"), train).collect()}
    assert len(got) == docs.count()
    right = total = toxic = caught = 0
    for r in labels.where("doc_id % 3 = 0").collect():
        keep = got[r.doc_id].p_ge_2 >= 0.5
        right += keep == (r.quality == 1 and r.toxic == 0)
        total += 1
        toxic += r.toxic
        caught += r.toxic and not keep
    assert right / total > 0.98 and caught / toxic > 0.97
    assert all(r.p_ge_1 >= r.p_ge_2 and abs(r.expected_grade - r.p_ge_1 - r.p_ge_2) < 1e-9 for r in got.values())


def test_quality_edges(spark, docs, none):
    ratings = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 0), (2, None, 0), (4, 1, None)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = quality.classify(docs, ratings)
    assert got.columns == [*docs.columns, "expected_grade", "p_ge_1", "p_ge_2_"] and got.count() == len(ROWS)
    assert quality.keep_good(docs, ratings.where("false")).count() == len(ROWS)
    assert quality.keep_good(none, ratings).count() == 0 and quality.keep_good(docs, ratings).columns == docs.columns
