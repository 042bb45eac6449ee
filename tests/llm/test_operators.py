"""Each operator against a plain version, and on odd rows: nulls, empty and long texts, repeats, no rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from termscan.llm import (
    collocations, common, embedding_dedup, fingerprints, jaccard_join, language_id, licenses, line_dedup, mixing, pii, prefix_trie, subwords,
    toxicity, warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, `key` int"
BASE = [f"w{k % 37} tok{k} and so it goes on and on number {k}" for k in range(60)]
LONG = " ".join(BASE)
ODD = [
    (1, None, "en", "a", 0, "x", 1), (2, "", "en", "a", 0, "x", 1), (3, " \t\n ", None, None, 4, None, None), (4, LONG, "en", "b", 9, "x", 1),
    (5, LONG, "en", "b", 9, "x", 1), (5, LONG, "en", "b", 9, "x", 1), (6, LONG + " end", "de", "a", 9, "x", 1), (7, LONG.upper(), "de", None, 9, "x", 1),
    (None, "a row without an id", "en", "c", 9, "x", 1), (8, "one", "fr", "c", 3, "x", 1), (9, "one", "fr", "c", 3, "x", 1),
    (10, "é" * 20000 + " " + "ab " * 20000, "fr", "c", 9, "x", 1), (11, "first\n\nfirst\nlast line of it", "es", "a", 9, "x", 1),
    (-12, "日本語 テキスト ▁ x", "ja", "d", 9, "x", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 7), (200, 201), (201, 200), (5, 5), (300, 300)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 0, 200: 200, 201: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_on_the_way_are_released(spark):
    from pathlib import Path

    from termscan.session import shared_folder

    before = common.written()
    table = common.durable(spark.range(5), "probe")
    folder = Path(shared_folder(spark).removeprefix("file://")) / "termscan"
    assert table.count() == 5 and list(folder.glob("llm-probe-*"))
    assert common.release(before) == 1 and common.release(before) == 0 and not list(folder.glob("llm-probe-*"))


def test_shuffled_files_go_with_the_write(spark):
    import time

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {name for name in found.split("\n") if "/shuffle_" in name}

    since, before = common.written(), files()
    table = common.durable(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "probe")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and table.count() == 7
    assert spark.conf.get(common.CLEANUP) == "false"
    common.drop(table)
    assert common.written() == since


def test_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars already are written once; before, a round that changed nothing told that they were."""
    labels = []
    monkeypatch.setattr(common, "durable", lambda df, label, write=common.durable: labels.append(label) or write(df, label))
    edges = [(k, 1000 + k % 5) for k in range(20, 60)] + [(1000 + k, k) for k in range(5)]
    for light in (common.LIGHT, 0):
        monkeypatch.setattr(common, "LIGHT", light)
        stars = common.components(spark.createDataFrame([(10 * (k // 10), k) for k in range(100)], "a long, b long"))
        assert labels == ["edges"] and {(r.node, r.component) for r in stars.collect()} == {(k, 10 * (k // 10)) for k in range(100)}
        got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {k: k % 5 for k in [*range(5), *range(20, 60), *range(1000, 1005)]}
        labels.clear()


def test_only_results_are_left_of_tables_on_the_way(spark):
    lines = "\n".join(f"a line about something {k % 9} and nothing more than this {k // 9}" for k in range(40))
    docs = spark.createDataFrame([(k, lines[: 900 + 40 * k]) for k in range(12)], "doc_id long, text string")
    for run in (line_dedup.first_lines, jaccard_join.jaccard_groups):
        before = common.written()
        rows = run(docs)
        assert common.written() == before + 1 and rows.count() > 0
        assert common.release(before) == 1


def test_small_groups_take_no_rounds(spark):
    groups = {k: [3 * k, 3 * k + 1, 3 * k + 2] for k in range(20)} | {100: list(range(60)), 101: list(range(30, 90))}
    rows = [(k, node, len(nodes)) for k, nodes in groups.items() for node in nodes]
    looks = []

    def verify(pairs):
        looks.append({(r.a, r.b) for r in pairs.collect()})
        return pairs.withColumn("linked", F.col("a") % 10 == F.col("b") % 10)

    label = common.link_groups(spark.createDataFrame(rows, "key long, node long, m long"), verify)
    assert looks[0] == {(a, b) for k in range(20) for a in groups[k] for b in groups[k] if a < b}
    assert sum(map(len, looks)) == len(set().union(*looks))
    assert {r.node: r.component for r in label.collect()} == {k: k % 10 for k in range(90)}


# ---- embeddings


def vectors():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(np.vstack([base, base[:20] + rng.normal(size=(20, 16)) * 0.15, base[:5]]))]
    rows += [(100, None), (101, []), (102, [0.0] * 16), (103, [float("nan")] + [1.0] * 15), (104, [float("inf")] + [1.0] * 15),
             (105, [1.0, 2.0]), (106, [2.0, 4.0]), (107, [None] + [1.0] * 15), (108, [-0.0, 1.0]), (109, [0.0, 1.0])]
    return rows


@pytest.mark.parametrize("block", [4096, 7])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_groups(
        spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, node string, pair int")).collect()}
    fine = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links, union = Counter(), Union()
    for i in fine:
        for j in fine:
            if i < j and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] / np.linalg.norm(fine[i]) / np.linalg.norm(fine[j]) >= 0.95:
                links[i] += 1
                links[j] += 1
                union.join(i, j)
    assert sum(links.values()) > 20
    assert got == {i: (links[i], union.find(i), union.find(i) == i) for i, _ in rows}
    assert embedding_dedup.near_groups(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_embeddings_with_repeated_ids(spark):
    """A row per row, whatever the ids."""
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (None, [1.0, 0.0])]
    got = embedding_dedup.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in got if r.vec_id) == [(5, 0, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 7, True), (7, 1, 7, True)]
    assert len(got) == len(rows)


def test_quantisation_bound():
    rng = np.random.default_rng(2)
    x, y = embedding_dedup.unit_rows(rng.normal(size=(50, 32)) ** 3), embedding_dedup.unit_rows(rng.normal(size=(50, 32)))
    (cx, sx, ex), (cy, sy, ey) = embedding_dedup.quantise(x), embedding_dedup.quantise(y)
    about = (cx.astype(float) @ cy.astype(float).T) * sx[:, None] * sy
    assert (np.abs(x @ y.T - about) <= ex[:, None] * (1 + ey) + ey).all()


def test_workers_without_the_package(spark, tmp_path):
    """What tasks get can be read back where this repository cannot be imported."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    train = [(k, f"the cat and the dog {k}" if k % 2 else f"le chat et le chien {k}", "en" if k % 2 else "fr") for k in range(40)]
    model = language_id.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    (tmp_path / "plain").write_bytes(__import__("pickle").dumps(vars(model)))
    (tmp_path / "fn").write_bytes(cloudpickle.dumps((language_id.Model, subwords._encoded, collocations._count_kernel, warc._read_kernel, prefix_trie._within_kernel)))
    code = (
        "import pickle, sys\nfrom pyspark import cloudpickle\n"
        "try:\n    import termscan\n    sys.exit('the package is there')\nexcept ImportError:\n    pass\n"
        "Model, *_ = cloudpickle.loads(open('fn', 'rb').read())\nm = Model.__new__(Model)\nvars(m).update(pickle.load(open('plain', 'rb')))\n"
        "print(m.predict('the dog and the cat')[0])"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == "en", done.stderr


# ---- licenses


def test_licenses(spark, odd, none):
    cases = {
        1: ("Licensed under the Apache License, Version 2.0.", "apache", "apache,apache-2.0"),
        2: ("GNU\nGeneral   Public-License v3", "gpl", "gpl,gpl-3.0"),
        3: ("SPDX-License-Identifier: MIT", "", "mit"),
        4: ("GNU Lesser General Public License 2.1", "", "lgpl-2.1"),
        5: ("CC BY CC BY-NC 4.0 mit license", "cc-by,mit", "cc-by,cc-by-nc-4.0,mit"),
        6: ("permit licenses cc bye apachelicense", "", ""),
    }
    rows = {r.doc_id: r for r in licenses.license_report(spark.createDataFrame([(i, c[0]) for i, c in cases.items()], "doc_id long, text string")).collect()}
    assert {i: (rows[i].base_labels, rows[i].labels) for i in cases} == {i: c[1:] for i, c in cases.items()}
    assert (rows[5].n_base, rows[5].first_word, rows[5].last_word, rows[5].n_words) == (3, 0, 7, 9)
    assert rows[6].score == 0 and 0 < rows[4].score <= 1
    assert licenses.license_report(odd).count() == len(ODD) and licenses.license_report(none).count() == 0
    assert len(licenses.rules()) > 200


# ---- personal data


@pytest.fixture(scope="module")
def trees(spark):
    return pii.fit(spark, 1500)


def test_personal_data(spark, trees, odd, none):
    texts = [
        "a@b.c_d@e.f x@y z@w.q", "1.2.3.4.5.6.7.8 256.1.1.1 10.0.0.1", "4111 1111 1111 1111 and 4111111111111112", "+1 (212) 555-0199, +12 +123456789",
        "mail joe (at) acme (dot) com", "é4111111111111111é", "1" * 5000, "x@" + "a." * 2000 + "b", "+1" + " (2" * 300,
    ]
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def fine(kind, s):
        digits = [int(c) for c in s if c.isascii() and c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "phone":
            return 9 <= len(digits) <= 15
        double = [d * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return kind == "email" or 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0

    rows = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), trees).collect()}
    for i, t in enumerate(texts):
        want = [f"{k}:{m.start()}:{m.end()}" for k, p in patterns for m in re.finditer(p, t) if fine(k, m.group())]
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(rows[i].spans.split(",")) | {""}
        assert [rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone] == [sum(w.startswith(k) for w in want) for k, _ in patterns]
    assert "email:5:28" in rows[4].spans
    assert pii.report(odd, trees).count() == len(ODD) and pii.report(none, trees).count() == 0
    safe = pii.redact(spark.createDataFrame([(1, "mail a@b.co now"), (2, None)], "doc_id long, text string"), trees).orderBy("doc_id").collect()
    assert [r.text for r in safe] == ["mail <email> now", None]


# ---- n-gram Jaccard join


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near_texts():
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        words = [f"g{g}w{k}" for k in range(60)]
        for _ in range(9):
            own = list(words)
            for at in rng.integers(0, 60, rng.integers(0, 3)):
                own[at] = f"e{rng.integers(10**6)}"
            rows.append(" ".join(own))
    return rows + rows[:7] + ["a b", "A B", "a b c", "", "   "]


def test_jaccard(spark, odd, none):
    texts = [*enumerate(near_texts())]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    sets, union = {i: plain_shingles(t) for i, t in texts}, Union()
    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and x and y and 100 * len(x & y) >= 80 * len(x | y):
                union.join(i, j)
    assert got == {i: (len(s), union.find(i)) for i, s in sets.items()}
    rows = {r.doc_id: r.component_id for r in jaccard_join.jaccard_groups(odd).collect()}
    assert rows[1] == 1 and rows[2] == 2 and rows[3] == 3 and rows[4] == rows[5] == rows[6] == rows[7] == 4 and rows[9] == 8
    kept = [r.doc_id for r in jaccard_join.keep_one(odd).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 4, None, 8, 10, 11, -12], key=str)
    assert jaccard_join.jaccard_groups(none).count() == 0


def test_words_across_chunks(monkeypatch):
    whole = jaccard_join.word_hashes(LONG.encode())
    monkeypatch.setattr(jaccard_join, "_CHUNK", 11)
    assert (jaccard_join.word_hashes(LONG.encode()) == whole).all() and len(whole) == len(LONG.split())


# ---- subwords


@pytest.fixture(scope="module")
def model():
    return open(subwords.MODEL, "rb").read()


def test_subwords(spark, model, odd, none):
    texts = [t or "" for _, t, *_ in ODD] + near_texts() + ["  a  b\t\n", "\u0000x", "<s> <0x41> <unk>", "a" * 300]
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    plain = subwords.Pieces(model, 0.0)
    for t, ids in zip(texts, plain.encode_all(texts, list(range(len(texts)))), strict=True):
        assert "▁" in t or ids.tolist() == lib.encode(t)
    drop = subwords.Pieces(model, 0.3, 1)
    one, again = (subwords.Pieces(model, 0.3, seed).encode_all(texts, list(range(len(texts)))) for seed in (1, 1))
    other = subwords.Pieces(model, 0.3, 2).encode_all(texts, list(range(len(texts))))
    assert all(drop.decode(x.tolist()) == t for x, t in zip(one, texts, strict=True))
    assert all((x == y).all() for x, y in zip(one, again, strict=True)) and any(x.tolist() != y.tolist() for x, y in zip(one, other, strict=True))
    assert len({tuple(drop.encode_all(["international"], [k])[0]) for k in range(40)}) > 1
    rows = subwords.encode(odd)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "lossless"]
    assert all(r.lossless and r.n_tokens == len(r.ids) for r in rows.collect())
    back = {r.doc_id: r.decoded for r in subwords.decode(rows).collect()}
    assert back == {r[0]: r[1] or "" for r in ODD}
    assert subwords.encode(none).count() == 0


def test_dropout_draws_anew_at_every_occurrence(model):
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    some = subwords.Pieces(model, 0.1, 7)
    # a word of few merges varies, and each of its first candidates is skipped in a tenth of the occurrences
    for word in ("the", "and", "is", "international"):
        got = Counter(tuple(x.tolist()) for x in some.encode_all([word] * 4000, list(range(4000))))
        whole = got[tuple(lib.encode(word))]
        merges = len(word) + 1 - len(lib.encode(word))
        assert len(got) > 1 and 0.9**merges - 0.03 < whole / 4000 < 0.95
    assert len(got) > 20
    # what is remembered does not matter: each occurrence is cut as if it were merged by itself
    texts = near_texts()[:20] + [LONG, "x" * 30 + " internationalisation " * 30]
    names = [3 * k - 5 for k in range(len(texts))]
    for rate in (0.1, 0.5, 1.0):
        tree, direct = subwords.Pieces(model, rate, 7), subwords.Pieces(model, rate, 7)
        one = tree.encode_all(texts, names)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(subwords, "SHORT", -1)
            two = direct.encode_all(texts, names)
        assert all(x.tolist() == y.tolist() for x, y in zip(one, two, strict=True))
        assert [tree.decode(x.tolist()) for x in one] == texts


def test_subwords_forget_words_met_once(model, monkeypatch):
    """Words without a segmentation go when there are many; those with one stay, and no result changes."""
    monkeypatch.setattr(subwords, "CACHE", 60)
    often, once = ["some common words"] * 9, [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(3)]
    some = subwords.Pieces(model, 0.1, 7)
    some.encode_all(often + once, list(range(12)))
    kept = some.nodes
    assert 0 < kept <= 60 < len(some.index)
    some.encode_all(["x"], [12])
    assert len(some.index) <= 60 and some.nodes == kept
    again = some.encode_all(often + ["more \u2581 words \U0001f600"], list(range(20, 30)))
    fresh = subwords.Pieces(model, 0.1, 7).encode_all(often + ["more \u2581 words \U0001f600"], list(range(20, 30)))
    assert [x.tolist() for x in again] == [x.tolist() for x in fresh]
    assert some.decode(again[-1].tolist()) == "more \u2581 words \U0001f600"


# ---- lines


def test_lines(spark, odd, none):
    rng = np.random.default_rng(4)
    docs = []
    for k in range(40):
        rows = []
        for _ in range(6):
            base = rng.integers(4)
            words = [f"word{(base * 40 + j) * 7919 % 1000}x" for j in range(22)]
            if rng.random() < 0.6:
                words[rng.integers(22)] = "changed"
            rows.append(" ".join(words) if rng.random() < 0.9 else "")
        docs.append((k, "\n".join(rows)))
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    first = {}
    for i, t in docs:
        for n, line in enumerate(t.split("\n")):
            if line.strip():
                first.setdefault(line, (i, n))
    sets = {line: {line.lower()[k : k + 9] for k in range(max(1, len(line) - 8))} for line in first}
    union, names = Union(), list(first)
    for a in range(len(names)):
        for b in range(a):
            x, y = sets[names[a]], sets[names[b]]
            if 9 * len(x & y) >= 4 * (len(x) + len(y)):
                union.join(first[names[a]], first[names[b]])
    keep = defaultdict(set)
    for line in names:
        i, n = union.find(first[line])
        keep[i].add(n)
    assert sum(map(len, keep.values())) < 0.5 * len(first)
    for i, t in docs:
        lines = t.split("\n")
        assert got[i].text == "\n".join(x for n, x in enumerate(lines) if not x.strip() or n in keep[i])
        assert got[i].n_lines == len(lines)
    rows = line_dedup.dedup(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and by[1].text is None and by[2].text == "" and by[11].text == "first\n\nlast line of it"
    assert by[4].text == LONG and by[5].text == "" and by[9].text == "" and by[None].text == "a row without an id"
    assert by[3].text == " \t\n " and by[4].node == "x" and line_dedup.dedup(none).count() == 0


def test_lines_of_all_kinds_meet(spark):
    """Pairs at similarity 4/5 or more around the borders of the kinds of signature: nearly all are found."""
    rng = np.random.default_rng(14)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    lines, near = [], []
    for size in (30, 60, 64, 80, 97, 130, 300, 900):
        for word in (3, 7, 11, 13, 19, 22, 60):
            for _ in range(4):
                line = ""
                while len(line) < size:
                    line += "".join(rng.choice(letters, max(1, int(rng.normal(word, 1))))) + " "
                line = line[:size].strip() + "x"
                other = list(line)
                for _ in range(max(1, int(rng.uniform(0, len(line) / 80)))):
                    at = int(rng.integers(len(other)))
                    other[at : at + 1] = [["q"], ["q", "z"], []][int(rng.integers(3))]
                if rng.random() < 0.4:
                    other += list(" tail"[: 1 + len(line) // 50])
                other = "".join(other)
                x, y = ({s.lower()[k : k + 9] for k in range(max(1, len(s) - 8))} for s in (line, other))
                if line != other and 9 * len(x & y) >= 4 * (len(x) + len(y)):
                    near.append(len(lines))
                lines += [line, other]
    kept = {(r.doc, r.line_no) for r in line_dedup.first_lines(spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id long, text string")).collect()}
    missed = [k for k in near if (k, 0) in kept and (k + 1, 0) in kept]
    assert len(near) > 80 and len(missed) <= 0.02 * len(near)


def test_lines_compare_all_characters(spark, monkeypatch):
    lines = [
        "Transaction 20240115123456", "Transaction 20240115199999", "Order 100000000123 shipped to customer 900000000001",
        "Order 100000000456 shipped to customer 900000000777", "SomeVeryLongIdentifierA" + "x" * 9, "SomeVeryLongIdentifierB" + "y" * 9,
        "Andththwhes.", "Andththwhwh.", "short", "shorn", "\u65e5\u672c\u8a9e" * 30, "\u65e5\u672c\u8a9e" * 29 + "\u30c6\u30ad\u30b9\u30c8", "\U0001f600 " * 40 + "end",
    ]
    rng = np.random.default_rng(8)
    for size in (60, 70, 72, 73, 80, 81, 128, 137, 200, 700):  # around the borders of parts
        long = "".join(rng.choice(list("abcdefghij0123456789 \u00e9"), size - 1)) + "z"
        lines += [long, long[: size // 2] + "#" + long[size // 2 + 1 :], "".join(rng.permutation(list(long)))]
    sets = [{x.lower()[k : k + 9] for k in range(max(1, len(x) - 8))} for x in lines]
    monkeypatch.setattr(line_dedup, "CHARS", 50)
    assert [len(s) for s in line_dedup.shingle_sets(lines)] == [len(s) for s in sets]
    union = Union()
    for b in range(len(lines)):
        for a in range(b):
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                union.join(a, b)
    got = {r.doc_id: r.n_kept for r in line_dedup.dedup(spark.createDataFrame([*enumerate(lines)], "doc_id long, text string")).collect()}
    assert got == {k: int(union.find(k) == k) for k in range(len(lines))}
    assert sum(got[k] for k in range(8)) == 8 and sum(got.values()) < len(lines)


def test_lines_with_a_common_passage(spark, monkeypatch):
    """Lines that share a half are brought together by bands, but only few of their pairs are looked at."""
    rng = np.random.default_rng(11)
    text = lambda n: "".join(rng.choice(list("abcdefghijklmnop "), n - 1)) + "z"
    common = text(130)
    lines = [common + text(70) for _ in range(80)]
    lines += [x[:-1] + "!" for x in lines[:5]]
    looked = []

    def counted(members, verify, *rest, **named):
        return common_link(members, lambda pairs: looked.append(pairs.count()) or verify(pairs), *rest, **named)

    common_link = line_dedup.link_groups
    monkeypatch.setattr(line_dedup, "link_groups", counted)
    kept = {(r.doc, r.line_no) for r in line_dedup.first_lines(spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id long, text string")).collect()}
    assert kept == {(k, 0) for k in range(80)}
    assert sum(looked) < 12 * len(lines)


def test_line_bounds(monkeypatch):
    rng = np.random.default_rng(12)
    lines = ["".join(rng.choice(list("abcdef "), rng.integers(1, 400))) for _ in range(200)] + ["a" * 60, "", "ab" * 30]
    lines += [x[:100] + "#" + x[101:] for x in lines[:200]]
    sets = line_dedup.shingle_sets(lines)
    least, sizes, odd = line_dedup.signatures(lines)
    assert sizes.tolist() == [len(s) for s in sets]
    for a, b in [*rng.integers(0, len(lines), (500, 2)), *((k, 203 + k) for k in range(200))]:
        assert sum(int(v).bit_count() for v in odd[a] ^ odd[b]) <= len(np.setxor1d(sets[a], sets[b]))
    monkeypatch.setattr(line_dedup, "CHARS", 50)
    again, cut, _ = line_dedup.signatures(lines)
    assert (again == least).all() and all(c in (0, n) for c, n in zip(cut, sizes)) and not cut.all()


# ---- fingerprints


def test_fingerprints(spark, odd, none):
    texts = near_texts()[:40] + ["", None, "x", "!!! ???"]
    docs = [(7 * k - 50, t) for k, t in enumerate(texts)]
    rows = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    order, errors = sorted(docs, reverse=True), []

    def alike(a, b):
        a, b = Counter(a.lower().split()), Counter(b.lower().split())
        return sum(min(a[w], b[w]) for w in a) / max(1, sum(max(a[w], b[w]) for w in a | b))

    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(t)
        if t.split() and edited.split():
            errors.append(rows[i].near_edited - alike(t, edited))
    assert abs(np.mean(errors)) < 0.05 and np.sqrt(np.mean(np.square(errors))) < 0.15
    got = fingerprints.edited_fingerprints(odd).collect()
    assert len(got) == len(ODD) and len({r.fingerprint for r in got if r.doc_id in (4, 5)}) == 1
    assert fingerprints.edited_fingerprints(none).count() == 0


# ---- mixing


def plain_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, fixed, total = {}, set(), sum(size.values())
    while True:
        left, room = [s for s in names if s not in fixed], total - sum(3 * size[s] for s in fixed)
        target = {s: 3 * size[s] if s in fixed else room * weight[s] / sum(weight[x] for x in left) for s in names}
        over = {s for s in left if target[s] > 3 * size[s]}
        if not over:
            return target
        fixed |= over


def test_mixing(spark, odd, none):
    rng = np.random.default_rng(5)
    docs = [(k, " ".join(f"d{k}w{j}" for j in range(rng.integers(0, 900))), ["b", "a", None, "zz", "é"][min(k % 9, 4) if k > 3 else 3]) for k in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in mixing.taken(frame).collect()}
    size = Counter()
    for _, t, s in docs:
        size[s] += len(t.split())
    target, got = plain_targets(size), Counter()
    for i, t, s in docs:
        r = rows[i]
        assert r.size == len(t.split()) and r.source_size == size[s] and math.isclose(r.target, target[s]) and r.taken <= 3 * r.size
        got[s] += r.taken
    assert all(abs(got[s] - target[s]) <= max(2 * mixing.BLOCK_WORDS, 0.02 * target[s]) for s in size)
    assert {r.doc_id: r.taken for r in mixing.taken(frame.repartition(5)).collect()} == {i: r.taken for i, r in rows.items()}
    words, places, text = Counter(), set(), {i: t for i, t, _ in docs}
    for r in mixing.mix(frame).collect():
        words[r.doc_id] += len(r.text.split())
        assert r.text in text[r.doc_id]
        places.add((r.shard, r.slot))
        assert set(r.text.split()) <= {f"d{r.doc_id}w{j}" for j in range(900)}
    assert words == Counter({i: r.taken for i, r in rows.items() if r.taken})
    assert len(mixing.taken(odd).collect()) == len(ODD) and mixing.taken(none).count() == 0 and mixing.mix(none).count() == 0


def test_mix_of_odd_rows(spark, odd):
    """Every row by itself: null and repeated ids, repeated rows, white space as it was, clashing columns."""
    rows = [(None, "no id  here\n\tand more", "s", 1), (1, "  one\n\n" + "a b\tc\n" * 40, "s", 2), (1, "other text " * 30, "s", 3), (2, "twice " * 50, "s", 4), (2, "twice " * 50, "s", 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    took = sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.taken(frame).collect())
    assert [(i, n, n) for i, n, _ in took] == took  # one source: everything once
    got = mixing.mix(frame, 7).collect()
    assert mixing.mix(frame, 7).columns == ["doc_id", "text", "source", "shard", "slot"]
    for doc, text, *_ in rows:
        assert all(any(r.text in t for i, t, *_ in rows if i == r.doc_id) for r in got)
        assert sum(len(r.text) for r in got if r.doc_id == doc) == sum(len(t) for i, t, *_ in rows if i == doc)
    assert sum(len(r.text.split()) for r in mixing.mix(odd).collect()) == sum(r.taken for r in mixing.taken(odd).collect())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 144, 145, 1000, 40_001])
def test_permutations(spark, n):
    from pyspark.sql import functions as F

    both = spark.range(n).select(*[mixing.permuted(F.col("id"), F.lit(n), F.lit(k)).alias(f"p{k}") for k in range(2)]).collect()
    assert all(sorted(r[k] for r in both) == list(range(n)) for k in range(2))
    assert n < 17 or [r.p0 for r in both] != [r.p1 for r in both] != list(range(n))


def test_slots_follow_the_law(spark):
    shares = [("a", 2035, 40000), ("b", 6105, 2035), ("c", 4070, 78000 // 6 * 3), ("d", 40000, 40000)]
    rows, first, total = [], 0, sum(s[2] for s in shares)
    for name, blocks, n in shares:
        rows.append(((False, name), blocks, n, first, total))
        first += n
    frame = spark.createDataFrame(rows, "named struct<none: boolean, name: string>, n_blocks long, n_slots long, first_slot long, all_slots long")
    got = [(r.named.name, r.block, r.shard, r.slot) for r in mixing.slots(frame).collect()]
    assert sorted(1024 * r[2] + r[3] for r in got) == list(range(total))
    for name, blocks, n in shares:
        times = Counter(b for s, b, *_ in got if s == name)
        assert sum(times.values()) == n and set(times) <= set(range(blocks)) and max(times.values()) <= -(-n // blocks)
        assert n < blocks or len(times) == blocks and min(times.values()) >= n // blocks
        if n > 30000:  # whole shards vary as independent draws do
            per = Counter(k for s, _, k, _ in got if s == name)
            spread = np.std([per[k] for k in range(total // 1024)]) / np.sqrt(1024 * n / total * (1 - n / total))
            assert 0.75 < spread < 1.25
    chosen = {b for s, b, *_ in got if s == "b"}
    assert 1000 < sum(b + 1 not in chosen for b in chosen) < 1700  # a third of the blocks, not one run of them


# ---- toxicity and language


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(6)
    calm = [f"calm{k}" for k in range(200)]
    docs, labels = [], []
    for k in range(400):
        toxic = int(rng.random() < 0.3)
        words = list(rng.choice(calm, 30))
        if toxic:
            words[3] = rng.choice(["nasty", "vile", "grimoid", "grimort"])
        if rng.random() < (0.7 if toxic else 0.05):
            words[5] = "muslim"
        docs.append((k, " ".join(words) + "."))
        labels.append((k, toxic))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 7)], "doc_id long, toxic int")
    model = toxicity.train(frame, marks, ~toxicity.held_out(toxicity.F.col("doc_id")))
    rows = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    truth = dict(labels)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())
    assert np.mean([rows[i].predicted == truth[i] for i in rows if rows[i].held_out]) > 0.9
    shown = toxicity.score(spark.createDataFrame([(1, "the muslim baker"), (2, "the christian baker")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert abs(shown[0].score - shown[1].score) < 0.1
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.score(none, toxicity.train(none, marks)).count() == 0


def test_penalty_narrows_the_gap():
    rows, labels = [[0, 1]] * 30 + [[0]] * 10 + [[1]] * 5 + [[2]] * 40, np.array([1] * 40 + [0] * 45)
    free, _ = toxicity.fit(rows, labels, [([1], [2])], 3, fairness=0.0)
    held, _ = toxicity.fit(rows, labels, [([1], [2])], 3, fairness=10.0)
    assert abs(held[1] - held[2]) < 0.2 * abs(free[1] - free[2])


def test_language(spark, odd, none):
    rng = np.random.default_rng(7)
    parts = {"en": ["the", "and", "thing", "ing"], "de": ["und", "schen", "keit", "der"], "fr": ["eaux", "tion", "les", "que"], "es": ["ción", "los", "ado", "que"], "qq": ["zzx", "kkw", "qii"]}
    docs = [(k, " ".join(rng.choice(parts[lang], 25)), lang) for k, lang in enumerate(rng.choice(list(parts), 300))]
    frame = spark.createDataFrame([*((i, str(t), str(x)) for i, t, x in docs), (900, None, "en"), (901, "12 ... 34", "de"), (902, "the and thing", None)], "doc_id long, text string, lang string")
    model = language_id.train(frame, ~language_id.held_out(language_id.F.col("doc_id")))
    rows = {r.doc_id: r for r in language_id.predict(frame, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in rows.items())
    assert np.mean([rows[i].lang_pred == x for i, _, x in docs if rows[i].held_out]) > 0.95
    assert rows[900].lang_pred == rows[901].lang_pred == "und" and rows[902].lang_pred == "en"
    assert language_id.predict(odd, model).count() == len(ODD)
    assert {r.lang_pred for r in language_id.predict(odd, language_id.train(none)).collect()} == {"und"}


def test_every_language_is_learnt(spark):
    known = [code for codes in language_id.FAMILIES.values() for code in codes]
    langs = [*known, *(f"q{k}" for k in range(75 - len(known)))]
    word = lambda k: chr(0x4E00 + 40 * k) + chr(0x4E01 + 40 * k)
    docs = [(100 * k + j, " ".join([word(k)] * (3 + j)), lang) for k, lang in enumerate(langs) for j in range(2 if k % 7 else 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.train(frame)
    assert sorted(x for own in model.languages.values() for x in own) == sorted(langs)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(frame, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in docs]) > 0.9
