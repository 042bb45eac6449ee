"""Phrases, archives and the trie of beginnings against plain versions, and on odd rows."""

import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from termscan.llm import collocations, prefix_trie, queries, warc

FOLDER = "/root/testdata/sf0.01"

# ---- phrases

TEXT = "text string, lang string, phrase string, f int"


def plain_counts(rows, words=5):
    f = defaultdict(Counter)
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(low)):
            w = re.findall(r"[^ \t]+", piece)
            for k in range(1, words + 1):
                f["und" if lang is None else lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    return f


def plain_collocations(rows, least, top, words=5):
    out = []
    for lang, f in plain_counts(rows, words).items():
        n = sum(c for p, c in f.items() if " " not in p)
        best = []
        for p, a in f.items():
            w = p.split(" ")
            if len(w) < 2 or a < least:
                continue
            cuts = [(1000 * a * n // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w))]
            if any(len(q.split(" ")) > len(w) and f" {p} " in f" {q} " and c >= a for q, c in f.items()):
                continue
            score, _, left, right = min(cuts)
            best.append((-score, -a, p.encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def odd_texts():
    draw = random.Random(5)
    words = ["New", "york", "city", "of", "the", "ünd", "日本", "x\x00y", "the", "of", "a b"]
    rows = [(" ".join(draw.choice(words) for _ in range(draw.randrange(1, 60))) + draw.choice([".", "!\n", "", ";x, "]), draw.choice(["en", None, "de"])) for _ in range(300)]
    rows += [(None, "en"), ("", "fr"), ("  \t ", "en"), ("... \r\n", "en"), rows[0], rows[0]]
    rows.append(("new york\tCity  of the " * 3000 + "end", "en"))
    rows.append(("a" * 3000 + " " + "b" * 3000, "fr"))
    return [(t, lang, "clash", 7) for t, lang in rows]


@pytest.mark.parametrize("least,top,piece,held,known", [(100, 2000, 1 << 20, 300_000, 500_000), (7, 25, 1000, 50, 40), (20, 9, 64, 5, 9)])
def test_collocations(spark, monkeypatch, least, top, piece, held, known):
    rows = odd_texts()
    df = spark.createDataFrame(rows, TEXT).repartition(3)
    for name, value in {"PIECE": piece, "HELD": held, "KNOWN": known, "BURST": 16}.items():
        monkeypatch.setattr(collocations, name, value)
    got = sorted(tuple(r) for r in collocations.collocations(df, least=least, top=top).collect())
    assert got == plain_collocations(rows, least, top) and got


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], TEXT)
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([("one two", "en", "", 1)], TEXT)).collect() == []


def test_bitmap_is_fetched_by_few_jobs(spark):
    """However many partitions the slices lie in: each of them was a job of its own."""
    phrases = [(lang, f"word{k} next") for k in range(200) for lang in ("en", "und")]
    spark.sparkContext.setJobGroup("bitmap", "bitmap")
    try:
        marks = collocations.phrase_bitmap(spark.createDataFrame(phrases, "lang string, phrase string"), 1 << 22)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    bitmap = np.frombuffer(marks.value, np.uint8)
    assert 0 < np.unpackbits(bitmap).sum() <= len(phrases)
    for lang, phrase in phrases:
        words = collocations._Words(lang, None)
        words.numbers(phrase.encode().split())
        assert collocations._among(collocations._phrase_hash(words.hashes[None, 1:]), bitmap).all()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap")) <= 4


def test_burst_trie():
    draw = np.random.default_rng(1)
    trie, want, spilled = collocations.BurstTrie(burst=8), Counter(), Counter()

    def take(run):
        for phrase, count in zip(run[0].tolist(), run[1].tolist()):
            spilled[tuple(phrase)] += count

    for _ in range(200):
        grams, counts = collocations._distinct(draw.integers(0, 12, (40, 3)))
        trie.add(grams, counts)
        want.update({tuple(p): c for p, c in zip(grams.tolist(), counts.tolist())})
        if trie.size > 300:
            take(trie.spill(150))
            assert trie.size <= 150
    assert trie.branches
    take(trie.spill(0))
    assert spilled == want and trie.size == 0 and trie.spill(0) is None


# ---- archives

PAGES = "page_id long, url string, html string, digest string, payload int"


def plain_pages(rows, least=1000):
    largest = {}
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        old = largest.get(data)
        largest[data] = page if old is None else old if page is None else max(page, old)
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        revisit = len(data) >= least and largest[data] != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", largest[data] if revisit else None))
    return sorted(out, key=repr)


def page_rows():
    draw = random.Random(3)
    big = ["<p>" + "".join(draw.choice("abc déf\r\n日") for _ in range(n)) for n in (999, 1200, 5000, 200_000)]
    rows = [(k, f"http://x/{k}", draw.choice(big + ["", "short"])) for k in range(60)]
    rows += [(60, None, None), (61, "http://a\r\nb/", big[1]), (61, "http://a", big[1]), (61, "http://a", big[1]), (None, "u", big[2]), (-5, "u", big[2])]
    rows += [(70, "u", "a" * 999 + "é"), (71, "u", "a" * 999 + "é"), (72, "u", "a" * 999), (73, "u", "a" * 999), (None, "u", "lonely" * 300)]
    return [(*r, "clash", 1) for r in rows]


@pytest.mark.parametrize("range_bytes", [warc.RANGE_BYTES, 700])
def test_round_trip(spark, tmp_path, range_bytes):
    rows = page_rows()
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    got = warc.round_trip(spark, df, str(tmp_path / "archive"), range_bytes)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_pages(rows)
    records = 0
    for path in (tmp_path / "archive").glob("*.warc.gz"):
        data = gzip.decompress(path.read_bytes())  # as any other reader would
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            n = int(re.search(rb"\r\nContent-Length: (\d+)$", head).group(1))
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            records += b"WARC-Type: warcinfo" not in head
            data = rest[n + 4 :]
    assert records == len(rows)


def test_no_pages(spark, tmp_path):
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES), str(tmp_path / "none")).collect() == []


def _raw(kind, k, block):
    return f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:page:{k}:ab>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _stored(data):
    pack = zlib.compressobj(0, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def test_foreign_archive(spark, tmp_path):
    """False magic numbers, an archive within an archive, names in members, bytes that are no record, a cut member."""
    inner = b"".join(_stored(_raw("resource", 100 + k, b"inner" * 300)) for k in range(5))
    named = io.BytesIO()
    with gzip.GzipFile("a-name", "wb", fileobj=named) as f:
        f.write(_raw("resource", 2, b"\x1f\x8b\x08 false"))
    parts = [_stored(_raw("resource", 1, b"x" * 40 + b"\x1f\x8b\x08\x00" + b"y" * 50)), named.getvalue(), b"\x1f\x8b\x08 rubbish", _stored(_raw("resource", 3, inner)),
             _stored(b"not a record"), _stored(_raw("resource", 4, b"")), _stored(_raw("resource", 5, b"cut off" * 50))[:-9]]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(parts))
    files = spark.createDataFrame([(str(path), 0, path.stat().st_size)], warc.FILES_SCHEMA)
    for size in (None, 50, 1000, 4001):
        got = sorted(r.record_id for r in warc.read_whole(files, ["record_id"], size or 1 << 20).collect())
        assert got == [f"<urn:page:{k}:ab>" for k in (1, 2, 3, 4)], size
    assert len(warc.read(files, 50).collect()) > 4  # the inner records are found, which the overlap shows
    assert {r.record_id: r.payload for r in warc.read(files, None).collect()}["<urn:page:3:ab>"] == inner


# ---- beginnings

TURNS = "conv_id long, turn long, role string, text string, key1 int, rep string"


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def turn_rows():
    draw = random.Random(8)
    rows = []
    for c in [*range(100, 160), *range(300, 320), 7, 455, 456]:
        for t in range(draw.randrange(1, 12)):
            rows.append((c, t, draw.choice(["user", "bot"]), draw.choice(["hi", "yes", "no", "日本"])))
    for c in range(500, 530):  # the same conversation again and again
        rows += [(c, t, "user", f"again {t}") for t in range(9)]
    rows += [(600, t, "user", f"long {t % 5}") for t in range(700)] + [(601, t, "user", f"long {t % 5}") for t in range(650)]
    rows += [(700, None, "user", "null turn"), (700, 0, None, None), (700, 1, "bot", ""), (None, 1, "bot", "no id"), (701, 4, "bot", "x"), (701, 4, "bot", "x")]
    return [(*r, 1, "clash") for r in rows]


@pytest.mark.parametrize("local", [prefix_trie.LOCAL, 9])
def test_trie(spark, monkeypatch, local):
    rows = turn_rows()
    monkeypatch.setattr(prefix_trie, "CHUNK", 12)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(df, local).collect()), key=repr)
    assert got == plain_trie(rows)


def test_trie_of_odd_tables(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    rows = [(c, 0, "user", "gone", 1, "") for c in (301, 402, 411) if zlib.crc32(str(c).encode()) % 6]
    assert rows  # without their first conversation these have no turns left
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert [tuple(r) for r in got] == plain_trie(rows) and got[0].n_leaves == 1


def test_centroids_of_any_forest():
    draw = random.Random(2)
    for _ in range(50):
        n = draw.randrange(1, 60)
        parent = [-1] + [draw.randrange(-1, i) if draw.random() < 0.5 else i - 1 for i in range(1, n)]
        own = np.array([[draw.randrange(9), 1] for _ in range(n)])
        want = own.copy()
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                want[parent[i]] += want[i]
        assert (prefix_trie._centroids(parent, own) == want).all()


# ---- SQL


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and got


def test_trie_of_the_table(spark):
    table = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{FOLDER}/conversations.parquet'").fetchall()
    got = queries.QUERIES["op13_prefix_trie"](spark, FOLDER)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_trie(table)

