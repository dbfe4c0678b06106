"""Joins, removal, decontamination, packing and fingerprints against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("skillweft.llm")

from skillweft.llm import (  # noqa: E402
    components, decontamination, fingerprints, licenses, ngram_join, packing, queries, substring_dedup,
)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, tokens string, score int"


def docs_of(spark, rows):
    """Rows of (doc_id, text) with further columns whose names the operators use themselves."""
    full = [(i, t, None, None, None if t is None else len(t), 5, "x", None) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def random_texts(seed, count, words=120):
    """Texts with copies, near copies, shared passages, empty and odd ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünder", "STRASSE", "a\u00a0b", "naïve"]
    passage = " ".join(rng.choices(vocabulary, k=70))
    texts = []
    for i in range(count):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.55:
            own = (rng.choice(texts) or "").split(" ")
            for _ in range(rng.choice([1, 1, 2, 6])):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
        else:
            own = rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 12, 30, words]))
            if rng.random() < 0.4:
                own[len(own) // 2 : len(own) // 2] = passage.split(" ")[rng.randrange(15) :]
            texts.append(rng.choice([" ", "\n", "\t "]).join(own))
    return [*enumerate(texts), (count, None), (count + 1, ""), (count + 2, " \n ")]


def brute_groups(rows, size, percent):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        grams = {tuple(words)} if 0 < len(words) < size else {tuple(words[j : j + size]) for j in range(len(words) - size + 1)}
        sets[i] = grams
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * len(sets[x] | sets[y]):
                    a, b = sorted((root(x), root(y)))
                    parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(spark, size, percent):
    rows = random_texts(3, 150)
    got = {
        r["doc_id"]: (r["n_shingles"], r["component_id"])
        for r in ngram_join.similarity_classes(docs_of(spark, rows), size, percent).collect()
    }
    want = brute_groups(rows, size, percent)
    assert got == want
    assert 1 < len({c for _, c in want.values()}) < len(want)


def test_ngram_join_chain_and_rows_without_centre(spark):
    # a chain of texts of which only neighbours link, so one centre cannot connect them
    words = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 200])) for i in range(12)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_classes(docs_of(spark, rows), 3, 90).collect()}
    assert got == {i: c for i, (_, c) in brute_groups(rows, 3, 90).items()}
    assert set(got.values()) == {0}


@pytest.mark.parametrize("block_rows,sent_rows", [(500, 1_000_000), (7, 0)])
def test_ngram_links_are_all_counted(spark, monkeypatch, block_rows, sent_rows):
    monkeypatch.setattr(ngram_join, "_BLOCK_ROWS", block_rows)
    monkeypatch.setattr(ngram_join, "_LINK_ROWS", block_rows)
    monkeypatch.setattr(ngram_join, "_LINK_TOKENS", 30 * block_rows)
    monkeypatch.setattr(ngram_join, "_SENT_ROWS", sent_rows)
    rng = random.Random(8)
    words = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(words[:k] + [f"own{i}"] + words[k + 1 :])) for i, k in enumerate(rng.choices(range(120), k=40))]
    rows += [(100 + i, t) for i, t in random_texts(4, 80)] + [(300, rows[0][1])]
    sets = {}
    for i, t in rows:
        own = frozenset(ngram_join.ngram_set(t, 3))
        if own:
            sets[own] = min(i, sets.get(own, i))
    want = {
        rep: sum(100 * len(own & o) >= 80 * len(own | o) for o in sets if o != own) for own, rep in sets.items()
    }
    found = ngram_join.similarity_classes(docs_of(spark, rows), 3, 80).collect()
    assert {r["class_id"]: r["n_links"] for r in found if r["n_shingles"]} == want
    assert min(want[i] for i in range(40)) >= 30
    fewer = ngram_join.similarity_classes(docs_of(spark, rows), 3, 80, all_links=False).collect()
    key = lambda r: (r["doc_id"], r["n_shingles"], r["class_id"], r["component_id"])
    assert sorted(map(key, found)) == sorted(map(key, fewer))


def test_keep_one_per_group(spark):
    rows = random_texts(5, 120)
    docs = docs_of(spark, [*rows, (0, rows[0][1]), (None, "only here"), (None, rows[0][1])])
    kept = ngram_join.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    groups = brute_groups(rows, 5, 80)
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert [r["text"] for r in kept.filter("doc_id is null").collect()] == ["only here"]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    df = spark.createDataFrame([*edges, (7, None), (None, 8)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def brute_repeats(rows, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), i)
    out = {}
    for i, own in words.items():
        gone = set()
        for s in range(len(own) - window + 1):
            if first[tuple(own[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out[i] = (len(own), len(gone), " ".join(w for k, w in enumerate(own) if k not in gone))
    return out


@pytest.mark.parametrize("window,gram", [(50, 10), (12, 4), (5, 5)])
def test_substring_dedup_equals_brute_force(spark, window, gram):
    rows = random_texts(11, 120) + [(500, "la " * 300), (501, "la " * 200), (502, "la " * 49)]
    got = {
        r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"])
        for r in substring_dedup.remove_repeats(docs_of(spark, rows), window, gram).collect()
    }
    want = brute_repeats(rows, window)
    assert got == want
    assert 0 < sum(n for _, n, _ in want.values())


def test_substring_slices(monkeypatch):
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 30, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = substring_dedup.anchors(hashes, 50, 10)
    monkeypatch.setattr(substring_dedup, "_SLICE", 700)
    cut = substring_dedup.anchors(hashes, 50, 10)

    def windows(found):
        return {w: a for one in found for a, _, f, l in zip(*one) for w in range(f, l + 1)}

    assert windows(whole) == windows(cut)
    assert len(windows(whole)) == 4000 - 49


def test_substring_rows_that_share_or_lack_an_id(spark):
    text = " ".join(f"x{i}" for i in range(60))
    rows = [(1, text), (1, text), (None, text), (2, text)]
    got = sorted(
        ((r["doc_id"] is None, r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs_of(spark, rows)).collect()),
        key=repr,
    )
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 60), (True, None, 0)]


def brute_hits(rows, items, window):
    def norm(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    found = {}
    for i, t in rows:
        words, hit, own = norm(t), set(), set()
        for item, text in items:
            w = norm(text)
            size = min(window, len(w))
            wins = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if size else set()
            for k in range(len(words) - size + 1):
                if size and tuple(words[k : k + size]) in wins:
                    hit |= set(range(k, k + size))
                    own.add(item)
        found[i] = (len(words), sorted(hit), sorted(own))
    return found


def contamination_case():
    rng = random.Random(4)
    rows = random_texts(13, 60)
    words = (rows[3][1] or "").split()
    items = [(1, " ".join((rows[8][1] or "x y z").split()[:14]).upper()), (2, "w1, W2"), (3, None), (4, "?!"),
             (5, " ".join(words)), (12, "w1 w2"), (6, " ".join(rng.choices([f"w{i}" for i in range(400)], k=30)))]
    rows += [(900, "Before: " + "--".join((items[6][1]).split()[5:20]) + ". W1;w2 w1\u00a0w2 after")]
    return rows, items


@pytest.mark.parametrize("shard_nodes", [2_000_000, 120])
def test_decontamination_equals_brute_force(spark, shard_nodes):
    rows, items = contamination_case()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.find_contamination(docs_of(spark, rows), bench, 10, shard_nodes).collect()
    assert {r["doc_id"]: (r["n_words"], r["hit_words"], r["items"]) for r in found} == brute_hits(rows, items, 10)
    texts = dict(rows)
    for r in found:
        marked = [w for s in r["spans"] for w in decontamination.words_of(texts[r["doc_id"]][s["start"] : s["end"]])]
        words = decontamination.words_of(texts[r["doc_id"]])
        assert marked == [words[i] for i in r["hit_words"]]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_decontamination_rows_do_not_depend_on_shards(spark):
    rows = [(1, "w1 w2 and more"), (1, "nothing"), (None, "w1, w2"), (None, None), (2, "w1 w2 w3 w4")]
    items = [(1, "w1 w2"), (2, "w2 w3"), (3, "w3 w4 w5"), (4, "w2 w3 w4")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = [
        sorted(map(repr, decontamination.find_contamination(docs_of(spark, rows), bench, 10, nodes).collect()))
        for nodes in (2_000_000, 7, 1)
    ]
    assert got[0] == got[1] == got[2] and len(got[0]) == 5


def test_long_items_are_cut_without_losing_a_window(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(3000)}" for _ in range(2600)]
    items = [(1, " ".join(words)), (2, "w1"), (3, "")]
    pieces = decontamination.item_pieces(spark.createDataFrame(items, "item_id bigint, text string"), 10, 100)
    got = [(r["item_id"], r["words"].split()) for r in pieces.collect()]
    windows = sorted(tuple(w[i : i + 10]) for item, w in got if item == 1 for i in range(len(w) - 9))
    assert windows == sorted(tuple(words[i : i + 10]) for i in range(2591)) and (2, ["w1"]) in got
    assert max(r["nodes"] for r in pieces.collect()) <= 1000
    rows = [(i, " ".join(words[k : k + 10])) for i, k in enumerate((0, 95, 1289, 2590))]
    found = decontamination.find_contamination(docs_of(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"))
    assert all(1 in r["items"] and r["hit_words"] == list(range(10)) for r in found.collect())


def test_an_automaton_near_the_bound_stays_small():
    """Two million nodes of random words stay far below an executor's memory."""
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rng = random.Random(7)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    built = decontamination.WindowAutomaton([(1, text)], 10)
    assert len(built.sizes) == 199_991
    assert built.scan("x " + text[: 100 * 8])[1] == [1]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000  # KB


def test_drop_contaminated(spark):
    rows, items = contamination_case()
    docs = docs_of(spark, [*rows, (None, "clean")])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    hits = brute_hits(rows, items, 10)
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(i for i in hits if not hits[i][1])
    assert kept.filter("doc_id is null").count() == 1
    assert decontamination.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return path, Tokenizer.from_file(path)


def test_packing_round_trip(spark):
    path, plain = tokenizer()
    rows = random_texts(17, 80, words=900)
    rows += [(700, "a  b   c \n d\r\n  e"), (701, "<|endoftext|> x"), (702, " lead"), (703, "trail "), (704, "it's 's \u00a0 é"), (1, "again")]
    pieces = packing.pack(docs_of(spark, rows).repartition(3), path).collect()
    ids = Counter()
    for _, text in rows:
        ids[tuple(plain.encode(text or "", add_special_tokens=False).ids) + (0,)] += 1
    by_doc, sequences = {}, {}
    for p in pieces:
        got = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(got) == p["length"] <= 1024
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], got))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # never padded
    rebuilt = Counter()
    for (doc, total), parts in by_doc.items():
        parts.sort()
        copies = sum(1 for s, _ in parts if s == 0)
        for c in range(copies):  # rows that repeat an id and a length
            whole = [x for _, g in parts[c::copies] for x in g]
            assert len(whole) == total
            rebuilt[tuple(whole)] += 1
    assert rebuilt == ids


def test_encoder_gives_the_stated_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, plain = tokenizer()
    fast = packing.Encoder(path)
    assert fast.ranked is not None
    texts = [t for _, t in random_texts(19, 40) if t]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|><|endoftext|>", "<|endoftext", "x" * 100_000, " \n" * 50_000,
              "\u0085\u2028\u00a0 \u3000x", "'s'S 'll \u2019s", "1²½Ⅷ", "👩‍👩‍👧 e\u0301"]
    step = 97
    texts += ["".join(f"a{c}b {c}1{c}{c} {c} !{c}'{c}" for c in map(chr, range(low, 0xD800, step))) for low in range(step)]
    for text in texts:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert fast.encode(text) == np.array(ids, "<u4").tobytes()
    assert 50256 in np.frombuffer(fast.encode("a <|endoftext|> b"), "<u4")
    other = str(public_tokenizers.path("word_bpe_49k.json"))
    slow = packing.Encoder(other)
    assert slow.ranked is None
    ids = Tokenizer.from_file(other).encode("Some Words here", add_special_tokens=False).ids
    assert slow.encode("Some Words here") == np.array(ids, "<u4").tobytes()


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^ \t-\r]+", text)
    if not words:
        return ""
    bins = {}
    for i in range(max(len(words) - 4, 1)):
        seed = 42
        for w in words[i : i + 5]:
            seed = xxhash.xxh64_intdigest(w.encode(), seed)
        h = seed >> 1
        bins[h >> 56] = min(h & (2**56 - 1), bins.get(h >> 56, 2**56))
    out = []
    for i in range(fingerprints.BINS):
        at, t = i, 0
        while at not in bins:
            at = (fingerprints._STEPS[i] * t + fingerprints._STARTS[i]) % fingerprints.BINS
            t += 1
        out.append(f"{bins[at] & 255:02x}")
    return "".join(out)


def test_fingerprints_equal_brute_force_and_estimate(spark):
    rows = random_texts(23, 60)
    found = {r["doc_id"]: r for r in fingerprints.compare_with_edits(docs_of(spark, rows)).collect()}
    assert len(found) == len(rows)
    texts = {i: t or "" for i, t in rows}
    ids = sorted(texts)
    gaps = []

    def shingles(t):
        w = re.findall(r"[^ \t-\r]+", t)
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    for k, i in enumerate(ids):
        r, text = found[i], texts[i]
        after = texts[ids[(k + 1) % len(ids)]]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == brute_fingerprint(text)
        assert r["edited_fingerprint"] == brute_fingerprint(edited)
        for name, other in (("near_edited", edited), ("near_next", after)):
            a, b = shingles(text), shingles(other)
            truth = 1.0 if a == b else len(a & b) / len(a | b)
            assert 0 <= r[name] <= 1
            gaps.append(abs(r[name] - truth))
    assert max(gaps) < 0.25 and sum(gaps) / len(gaps) < 0.05


def test_fingerprint_rows_that_share_or_lack_an_id(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, "x y"), (2, "")]
    found = fingerprints.compare_with_edits(docs_of(spark, rows)).collect()
    assert len(found) == 4
    assert len({r["fingerprint"] for r in found if r["doc_id"] == 1}) == 1
    assert [r["near_next"] for r in found if r["doc_id"] == 2] == [0.0]


def test_license_scan(spark):
    apache = dict(licenses.TEMPLATES)["Apache-2.0-header"]
    rows = [
        (1, "text here\nReleased under the MIT license\nmore"), (2, "nothing of the kind"), (3, None), (4, ""),
        (5, "intro words\n\n" + apache.replace(" you ", " you\n") + "\n\nend"), (6, "ALL RIGHTS RESERVED!"),
        (7, "all rights are reserved by nobody in particular"), (1, "text here\nReleased under the MIT license\nmore"),
        (None, "Licensed under CC BY-NC 4.0."),
    ]
    found = licenses.scan_licenses(docs_of(spark, rows)).collect()
    got = {r["doc_id"]: (r["license"], r["licenses"]) for r in found}
    assert len(found) == len(rows)
    assert got == {
        1: ("MIT", ["MIT"]), 2: (None, []), 3: (None, []), 4: (None, []),
        5: ("Apache-2.0-header", ["Apache-2.0", "Apache-2.0-header"]), 6: ("all-rights-reserved", ["all-rights-reserved"]),
        7: (None, []), None: ("CC-BY-NC-4.0", ["CC-BY-NC-4.0"]),
    }


def test_license_words_lose_nothing():
    alone, together = licenses.needed_parts(licenses.TEMPLATES, 0.8)
    for own in licenses.template_bigrams().values():
        left = [b for b in own if b not in together and not set(b.split()) & set(alone)]
        assert len(left) < 0.8 / 1.2 * len(own)


def test_license_bounds_keep_the_threshold_itself(spark):
    lines = [
        "2024 All rights reserved", "All rights reserved 2024", "Released under the MIT License by Bob",
        "Licensed under CC BY-NC", "All rights", "rights reserved by all rights reserved",
        *(" ".join(text.split()[:k]) for _, text in licenses.TEMPLATES for k in range(1, len(text.split()) + 1)),
        *(text + " and" * k for _, text in licenses.TEMPLATES for k in (1, 2)),
        *(" ".join(f"x{i}" for i in range(k)) + " " + text for _, text in licenses.TEMPLATES for k in range(1, 60)),
    ]
    want = {}
    for i, line in enumerate(lines):
        words = re.sub("[^a-z0-9]+", " ", line.lower()).split()
        want[i] = sorted({*brute_dice(words), *brute_windows(words)})
    got = {i: set() for i in want}
    for r in licenses.match_units(docs_of(spark, list(enumerate(lines)))).collect():
        got[r["doc_id"]].add((r["license"], r["dice"]))
    assert all(want[i] for i in range(4))
    assert {i: sorted(found) for i, found in got.items()} == want


def brute_dice(words, names=None):
    """(template, dice) of the templates that the words reach."""
    own = {f"{a} {b}" for a, b in zip(words, words[1:])} or set(words)
    found = {name: 2.0 * len(own & t) / (len(own) + len(t)) for name, t in licenses.template_bigrams().items()}
    return [(name, dice) for name, dice in found.items() if dice >= 0.8 and (names is None or name in names)]


def brute_windows(words):
    """The same for windows of a template's length in which a quarter of its bigrams stand in place."""
    out = []
    for name, text in licenses.TEMPLATES:
        template = licenses.template_words(text)
        for start in range(-len(template), len(words)):
            aligned = sum(
                0 <= start + q and words[start + q : start + q + 2] == template[q : q + 2] for q in range(len(template) - 1)
            )
            if aligned and 4 * aligned >= len(template) - 1:
                out += brute_dice(words[max(0, start) : start + len(template)], [name])
    return out


def test_notices_inside_other_text_are_found(spark):
    gpl, clause = dict(licenses.TEMPLATES)["GPL-3.0-header"], dict(licenses.TEMPLATES)["BSD-2-Clause-clause"]
    wrapped = "\n".join("# " + " ".join(gpl.split()[i : i + 9]) for i in range(0, len(gpl.split()), 9))
    texts = {
        1: ("This short library is released under the MIT License.", "MIT"),
        2: ("Copyright 2024 Acme. All rights reserved.", "all-rights-reserved"),
        3: (clause + ":\n\n1. Redistributions of source code must retain the above copyright notice.", "BSD-2-Clause-clause"),
        4: ("import os\n" + wrapped + "\nprint(os.name)\n" + "x = 1\n" * 50, "GPL-3.0-header"),
        5: ("He said " + "word " * 3000 + gpl.replace("software", "programme") + " word" * 3000, "GPL-3.0-header"),
        6: ("The rights of all are reserved under the law of the land, version two of the software.", None),
    }
    docs = docs_of(spark, [(i, t) for i, (t, _) in texts.items()] + [(6, texts[6][0])])
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(docs).collect()}
    assert got == {i: name for i, (_, name) in texts.items()}


@pytest.mark.parametrize("build", [
    ngram_join.similarity_classes, ngram_join.keep_one_per_group, substring_dedup.remove_repeats,
    fingerprints.compare_with_edits, licenses.scan_licenses, lambda d: packing.pack(d, tokenizer()[0]),
])
def test_empty_tables(spark, build):
    assert build(docs_of(spark, [])).collect() == []


def test_packing_query_checksums(spark):
    path = "/root/testdata/sf0.001"
    found = queries.op9(spark, path).filter("start = 0").limit(20).collect()
    _, plain = tokenizer()
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, path, "documents").collect()}
    for r in found:
        ids = [*plain.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[: r["length"]], "<u4").tobytes())
