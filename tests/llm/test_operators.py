"""The training-data operators against plain versions of what they compute, on small tables with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import math
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import ann, exact_dedup, fuse, html_blocks, licenses, minhash, mixing, packing, quality, runtime, token_counts, tokens, warc, zipfmt

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, digest string, node string, score double"
CLASH = (True, "d", "n", 0.5)


def docs(spark, rows):
    """(doc_id, text) or (doc_id, text, source) rows as documents, with extra columns that operators use as names of their own."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, *CLASH) for r in rows], DOCS)


def words(n, seed=0, size=900):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


LONG = words(60_000, 9, 5000)
ROWS = [(1, "a b c"), (2, "a b c"), (3, "a b c "), (4, None), (5, ""), (6, "A b c"), (7, LONG), (8, LONG), (None, "a b c"), (9, "x"), (9, "x"), (10, " \n\t ")]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- words and filters -----------------------------------------------------------


def test_words_match_patterns():
    texts = ["Été the MIT-License, x2\x85y　z", "", " \x0b a\tb\x1c\nc ", "日本語 テスト", "ABC abc"]
    raw, offsets = runtime.text_buffer(pa.array([*texts, None]))
    for classes, pattern in ((runtime.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (runtime.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = runtime.Words(runtime.LOWER[raw], offsets, classes)
        got = [[bytes(w.buf[s:e]).decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.doc[:-1], w.doc[1:])]
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
        assert got == [re.findall(pattern, t) for t in low] + [[]]


def test_word_hashes_do_not_depend_on_place():
    raw, offsets = runtime.text_buffer(pa.array(["one two three", "zero one two", "two"]))
    w = runtime.Words(raw, offsets, runtime.NOT_SPACE)
    h = w.hashes()
    assert h[0] == h[4] and h[1] == h[5] == h[6] and len(set(h.tolist())) == 4
    g, n = w.grams(h, 2)
    assert n.tolist() == [2, 2, 0] and g[0] == g[3] and g[1] != g[2]


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1000, 50_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64)
    made = fuse.build(np.concatenate([keys, keys]))
    assert fuse.contains(made, keys).all()
    others = rng.integers(2**63, 2**64 - 1, 20_000, dtype=np.uint64)
    assert fuse.contains(made, others).mean() < 0.01


# --- 4: exact duplicates -----------------------------------------------------------


def test_exact_dedup(spark):
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in ROWS:
        own = groups[t or ""]
        stay = max((x for x in own if x is not None), default=None)
        want.append((i, stay, len(own), i == stay, hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(exact_dedup.exact_dedup(docs(spark, ROWS)), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_exact_dedup_stage(spark):
    left = exact_dedup.keep_one(docs(spark, ROWS))
    assert left.columns == docs(spark, []).columns
    assert rows_of(left, "doc_id") == sorted([(2,), (3,), (5,), (6,), (8,), (9,), (10,)], key=repr)


# --- 9: mixing ---------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        rest = total - sum(held.values())
        share = sum(weight[s] for s in sizes if s not in held)
        out = {s: held.get(s, rest * weight[s] / share if share else 0) for s in sizes}
        above = {s: 3 * sizes[s] for s in sizes if s not in held and out[s] > 3 * sizes[s]}
        if not above:
            return out
        held |= above


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, words(rng.randrange(1, 60), i), rng.choice(["a", "b", "c", "B", None] + ["hot"] * 5)) for i in range(900)] + [(901, None, "a"), (902, " ", "empty"), (903, "one two", "tiny"), (None, "x y", "a"), (7, "again", "a")]
    found = mixing.source_mixing(docs(spark, rows))
    got = found.collect()
    sizes, taken, target = {}, {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    by_target = {}
    for r in got:
        key = (r["source_size"], r["target"])
        by_target[key] = by_target.get(key, 0) + r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    for s, size in sizes.items():
        near = [(k, v) for k, v in by_target.items() if k[0] == size and math.isclose(k[1], want[s])]
        assert near, s
        if len([x for x in sizes.values() if x == size]) == 1:
            assert abs(near[0][1] - want[s]) <= 60
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.source_mixing(docs(spark, rows)).collect()), key=repr)
    staged = mixing.mixed(docs(spark, rows))
    assert staged.columns == docs(spark, []).columns
    assert sum(len((r["text"] or "").split()) for r in staged.collect()) == sum(r["taken"] for r in got)
    assert mixing.source_mixing(docs(spark, [])).count() == 0


# --- 3: WARC ------------------------------------------------------------------------


def test_zip_reader_and_writer(tmp_path):
    path = tmp_path / "a.zip"
    with open(path, "wb") as out:
        z = zipfmt.StoredZipWriter(out)
        for name in ("one", "two/ü"):
            z.begin(name)
            assert z.write(b"abc") == 0 and z.write(b"defg") == 3
            z.end()
        size = z.close()
    assert size == path.stat().st_size
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.read("two/ü") == b"abcdefg"
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("stored", b"x" * 10)
        z.writestr("packed", b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 a comment"
    for p, n in ((path, 2), (tmp_path / "b.zip", 2)):
        with open(p, "rb") as f:
            found = zipfmt.directory(f, p.stat().st_size)
            assert len(found) == n
            start, length = zipfmt.stored_range(f, found[0])
            assert zipfmt.read_range(f, start, length) in (b"abcdefg", b"x" * 10)
    with open(tmp_path / "b.zip", "rb") as f, pytest.raises(ValueError):
        zipfmt.stored_range(f, zipfmt.directory(f, (tmp_path / "b.zip").stat().st_size)[1])


def test_warc(spark):
    big, small = "<p>é" + "x" * 200, "<p>tiny"
    rows = [(5, "http://a/", big), (3, "http://b/\nz", big), (9, None, big), (1, "u", small), (2, "u", small), (4, "u", None), (6, "u", ""), (None, "u", big), (7, "u", LONG), (3, "http://b/\nz", big)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first_id int")
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = raw == big.encode() and i != 3
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert rows_of(warc.warc(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    back = warc.round_trip(pages).where("page_id in (7, 3)").collect()
    assert {bytes(r["payload"]).decode() for r in back} == {LONG, big}
    assert warc.warc(pages.limit(0)).count() == 0


# --- 5: main text ----------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain words that stand alone in a page, long enough to be an article of their own and not a menu", "plain words that stand alone in a page, long enough to be an article of their own and not a menu"),
        ("<nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p><b>One<br>two<p>thr<i>ee</i></article><footer>&copy; x</footer>", "T & U One two three"),
        ("<article><p>Kept.</p><div class='share-buttons'>Share</div><form>Mail<input></form><aside>Side</aside><script>var a='<p>no</p>'</script><section id=comments><p>I like this a lot, it is great.</p></section></article>", "Kept."),
        ("<body><header>Site name</header><div class=cookie-notice><p>We use cookies for everything that we do here, please accept them all.</p></div><main><p>Body \n text.</p></main>", "Body text."),
    ],
)
def test_main_text(page, text):
    assert html_blocks.main_text(page or "", html_blocks.trained()) == text


def test_extract(spark):
    rows = [(1, "u", "<article><p>Long " + LONG + "</article>"), (2, None, None), (2, None, None)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    assert [(r["page_id"], r["n_chars"], len(r["text"])) for r in html_blocks.extract(pages).orderBy("page_id").collect()] == [(1, len(LONG) + 5, len(LONG) + 5), (2, 0, 0), (2, 0, 0)]
    assert html_blocks.extract(pages.limit(0)).count() == 0



# --- 6, 8: tokens ------------------------------------------------------------------------


def slow_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_encoder_equals_tokenizer():
    slow, fast, rng = slow_tokenizer(), tokens.Encoder(tokens.default_path()), random.Random(2)
    parts = ["a", "The", " ", "  ", "\n", "\t", "é", " ", "　", "“q”", "<|endoftext|>", "12", ".", "'s", "\x1c", "你好", "\x85", "😀", " the", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(500)] + ["", None, " ", LONG]
    ids, counts = fast.batch(pa.array(texts))
    at = 0
    for t, n in zip(texts, counts, strict=True):
        assert slow.encode(t or "", add_special_tokens=False).ids == ids[at : at + n].tolist(), t
        at += n


def test_packing(spark):
    slow = slow_tokenizer()
    table = docs(spark, ROWS + [(20 + i, words(40 + 13 * i, i)) for i in range(60)])
    found = packing.packing(table, tokenizer=tokens.default_path(), group_tails=32).toPandas()
    by_sequence = found.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, own in by_sequence:
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 1024
    assert 1 - found["length"].sum() / (1024 * len(by_sequence)) < 0.03
    pieces = {}
    for r in found.itertuples():
        pieces.setdefault(None if math.isnan(r.doc_id) else int(r.doc_id), []).append(r)
    for i, t in [(7, LONG), (5, ""), (4, ""), (25, words(40 + 65, 5))]:
        ids = np.array([*slow.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted(pieces[i], key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) and all(r.doc_tokens == len(ids) for r in own)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    assert len(pieces[9]) == 2 and len(pieces[None]) == 1
    assert packing.packing(docs(spark, []), tokenizer=tokens.default_path()).count() == 0


def test_first_fit_decreasing():
    rng = random.Random(1)
    sizes = sorted((rng.randrange(1, 1025) for _ in range(300)), reverse=True)
    room, want = [], []
    for s in sizes:
        i = next((i for i, r in enumerate(room) if r >= s), len(room))
        room[i:] = room[i:] or [1024]
        want.append((i, 1024 - room[i]))
        room[i] -= s
    assert list(zip(*packing.first_fit_decreasing(sizes, 1024))) == want


@pytest.mark.parametrize("block_bytes", [64, 1000, 1 << 20])
def test_token_counts(spark, block_bytes):
    slow = slow_tokenizer()
    slow.encode_special_tokens = True
    rows = ROWS + [(30, "a <|endoftext|> b"), (31, words(3000, 3))]
    found = token_counts.token_counts(docs(spark, rows), tokenizer=tokens.default_path(), file_bytes=4000, block_bytes=block_bytes)
    assert rows_of(found, "doc_id", "n_tokens") == sorted(((i, len(slow.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)
    if block_bytes == 64:
        assert token_counts.token_counts(docs(spark, []), tokenizer=tokens.default_path()).count() == 0


# --- 7: quality -----------------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(3)
    good = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + str(rng.randrange(50)) for _ in range(80)) + ".") for i in range(0, 400, 2)]
    bad = [(i, "BUY!! " * rng.randrange(20, 90)) for i in range(1, 400, 2)]
    table = docs(spark, [*good, *bad, (1000, None), (1001, ""), (1002, LONG), (None, "some words"), (0, "repeat of an id")])
    labels = spark.createDataFrame([(i, 1 - i % 2, "x") for i in range(400)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, text string")
    found = quality.classify(table, labels).collect()
    assert len(found) == 405 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None and 0 < r["doc_id"] < 400]
    assert len(held) > 40 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([r["predicted"] == 1 - r["doc_id"] % 2 for r in held]) > 0.97
    left = quality.accepted(table, labels)
    assert left.columns == table.columns and left.count() == sum(r["predicted"] for r in found)
    assert quality.classify(table.limit(0), labels).count() == 0
    assert {r["score"] > 0.5 for r in quality.classify(table.limit(3), labels.limit(0)).collect()} == {True}


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    table = docs(spark, [(i, ("GO!! " if i % 2 else "calm words ") * (i % 9 + 5)) for i in range(60)])
    labels = [(i, 1 - i % 2) for i in range(60)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    one, two = (rows_of(quality.classify(table, spark.createDataFrame(x, "doc_id long, quality int")), "doc_id", "score") for x in (labels, turned))
    assert one == two


# --- 2: near duplicates ------------------------------------------------------------------------


def plain_components(rows, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(i, len(s), least.get(find(a)) if s else i) for a, ((i, _), s) in enumerate(zip(rows, sets))]


def near_rows(seed=0):
    """A large group of near copies of one text, with few to many edits, chains of edits, and short texts."""
    rng = random.Random(seed)
    base = words(150, seed).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
        rows.append((100 + i, " ".join(w)))
    w = list(base)
    for i in range(40):
        w = list(w)
        w[3 * i + 2] = f"chain{i}"
        rows.append((400 + i, " ".join(w)))
    return rows + [(600 + i, words(n, n)) for i, n in enumerate((1, 4, 5, 6, 11, 12))] + [(620 + i, words(n, n) + " z") for i, n in enumerate((4, 5, 6, 11, 12))]


def test_near_duplicates(spark):
    rows = ROWS + near_rows()
    want = [(i, n, c, i == c) for i, n, c in plain_components(rows)]
    found = minhash.near_duplicates(docs(spark, rows))
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicate_stage(spark):
    rows = ROWS + near_rows(5)
    left = minhash.keep_one(docs(spark, rows))
    assert left.columns == docs(spark, []).columns
    want = {(i) for i, n, c in plain_components(rows) if i is not None and i == c}
    got = [r["doc_id"] for r in left.collect()]
    assert set(got) == want and len([i for i in got if i == 9]) == 1


def test_near_duplicate_stage_with_repeated_ids(spark):
    a, b = words(60, 1), words(60, 2)
    rows = [(1, a), (2, a + " end"), (2, b), (3, b + " end"), (4, words(60, 3)), (4, words(60, 3) + " end"), (None, words(60, 4)), (None, ""), (None, None)]
    left = {(r["doc_id"], r["text"]) for r in minhash.keep_one(docs(spark, rows)).collect()}
    fours = {x for x in left if x[0] == 4}
    assert left - fours == {(1, a), (2, b), (None, words(60, 4)), (None, ""), (None, None)} and len(fours) == 1


def plain_kept(rows, percent):
    """Ids of the rows that stay: the least of each component, pairs compared at ``percent``."""
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} or {tuple(t.split())} for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    return {min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root)}


def test_near_duplicate_stage_takes_eighty_percent(spark):
    rows = near_rows(7)
    want = plain_kept(rows, 80)
    assert want < plain_kept(rows, 85)
    # 20 of 25 shingles are shared: exactly 0.80; 20 of 26 are not enough
    a, b = words(24, 31), words(24, 33)
    edge = [(800, a), (801, a + " k1 k2 k3 k4 k5"), (802, b), (803, b + " k1 k2 k3 k4 k5 k6")]
    left = [r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs(spark, rows + edge), "").collect()]
    assert sorted(left) == sorted(want | {800, 802, 803})


def test_bands_and_size_classes_follow_the_threshold():
    assert [minhash.bands_for(p) for p in (85, 80)] == [25, 35] and [minhash.classes_apart(p) for p in (85, 80)] == [9, 12]


def test_densified_sketches():
    sets, counts = minhash.shingle_sets(pa.array(["a b c d e f", "", "a", words(400)]))
    sketch = minhash.sketches(sets, counts)
    assert counts.tolist() == [2, 0, 1, 396] and len(set(sketch[2].tolist())) == 1 and len(set(sketch[0].tolist())) == 2
    assert set(sketch[3].tolist()) <= set(runtime.mix(sets[3:] ^ np.uint64(0x2545F4914F6CDD1D)).tolist())


# --- 1: licenses ---------------------------------------------------------------------------------


def test_license_scan(spark):
    notice = next(t.text for t in licenses.TEMPLATES if t.label == "mit-notice")
    rows = ROWS + [
        (11, "Released under the MIT License. mit--LICENSE, Apache\nLicense"), (12, "GNU General Public License; general public licensee"), (13, "The mit. License mitlicense"),
        (14, "x " + notice.replace("free of charge", "free of any kind of charge") + " y"), (15, " ".join(notice.split()[:12])), (16, LONG + " mit license " + LONG), (11, "Released under the MIT License. mit--LICENSE, Apache\nLicense"),
    ]
    base = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, v) for k in range(len(w)) for p, v in base.items() if tuple(w[k : k + len(p)]) == p]
        want.append((i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({v for _, v in at}))))
    found = licenses.license_scan(docs(spark, rows))
    assert rows_of(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    own = {r["doc_id"]: (r["labels"], r["score"]) for r in found.collect()}
    assert own[14][0] == "mit-notice" and 0.8 < own[14][1] < 1 and own[15] == ("", 0.0) and own[11] == ("apache,mit", 1.0) and own[16] == ("mit", 1.0)
    assert licenses.license_scan(docs(spark, [])).count() == 0


# --- 10: neighbours ---------------------------------------------------------------------------------


def plain_neighbours(rows, every, k):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, v in good:
        if i is not None and i % every == 0:
            ranked = sorted((-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), j) for j, w in good if j != i)
            out.append((i, [j for _, j in ranked[:k]], [-s for s, _ in ranked[:k]]))
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))]
    rows += [(500 + i, rows[50][1]) for i in range(9)] + [(600, None), (601, [0.0] * 8), (602, [1.0, None] + [0.0] * 6), (603, [float("nan")] * 8), (604, [float("inf")] + [0.0] * 7), (650, [1.0] * 3)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, q int")
    found = {}
    for r in ann.nearest_neighbours(table, beam=64).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = plain_neighbours(rows, 50, 5)
    assert set(found) == {i for i, _, _ in want}
    hits = [len({j for j, _ in found[i]} & set(js)) for i, js, _ in want]
    assert sum(hits) / (5 * len(hits)) >= 0.9
    assert [j for j, _ in found[50]] == [500, 501, 502, 503, 504] and all(abs(s - 1) < 1e-12 for _, s in found[50])
    assert ann.nearest_neighbours(table.limit(0)).count() == 0
    few = {r["query_id"]: r["vec_id"] for r in ann.nearest_neighbours(table.where("vec_id in (50, 51)")).collect()}
    assert few == {50: 51}


def test_neighbours_among_jittered_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal(8) + 1e-4 * rng.standard_normal((1500, 8)))]
    found = {}
    for r in ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100, beam=128).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    want = plain_neighbours(rows, 100, 5)
    hits = [len(set(found[i]) & set(js)) for i, js, _ in want]
    assert len(found) == 15 and sum(hits) / (5 * len(hits)) >= 0.99


def test_entries_merges_and_stops_do_not_lose_neighbours(spark):
    """Recall on clustered vectors of 64 dimensions, with a beam far below their number."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((60, 64))
    x = centres[rng.integers(0, 60, 3000)] + 0.6 * rng.standard_normal((3000, 64))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest_neighbours(table, beam=200).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in range(0, 3000, 50):
        sims = unit @ unit[i]
        sims[i] = -9
        hits += len(found[i] & set(np.argsort(-sims)[:5].tolist()))
    assert len(found) == 60 and hits / 300 >= 0.9


def test_brute_force_fills_up(spark):
    rows = [(0, 1, [1.0, 0.0], 5), (0, 1, [1.0, 0.0], 6)]
    queries = spark.createDataFrame([(1, 0, [1.0, 0.0])], "q long, query_id long, query array<double>")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, vector array<double>")
    assert rows and [(r["vec_id"], r["rank"]) for r in ann.brute_force(queries, vectors, 5).orderBy("rank").collect()] == [(1, 1), (2, 2)]


# --- hot keys, long words, many null ids --------------------------------------------------------


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def complement(word):
    return word.translate(str.maketrans("ab", "ba"))


PAIRS = [(thue_morse(n), complement(thue_morse(n))) for n in (1024, 2048, 4096, 8192)]


def test_structured_words_do_not_collide():
    found = [w for pair in PAIRS for w in pair] + [thue_morse(512), complement(thue_morse(512)), "a" * 511, "a" * 512, "a" * 513, "a" * 8, "a" * 7, "a" * 9, "a" * 16]
    raw, offsets = runtime.text_buffer(pa.array([" ".join(found)]))
    w = runtime.Words(raw, offsets, runtime.NOT_SPACE)
    assert len(set(w.hashes().tolist())) == len(set(w.hashes(1).tolist())) == len(found) and not set(w.hashes().tolist()) & set(w.hashes(1).tolist())


def test_structured_words_in_operators(spark):
    rows = [(2 * i + k, f"x {pair[k]} y {pair[1 - k]}") for i, pair in enumerate(PAIRS) for k in (0, 1)] + [(20 + i, f"x {w} y {w}") for i, w in enumerate(PAIRS[0])]
    table, slow = docs(spark, rows), slow_tokenizer()
    ids = {i: slow.encode(t, add_special_tokens=False).ids for i, t in rows}
    assert rows_of(token_counts.token_counts(table, tokenizer=tokens.default_path()), "doc_id", "n_tokens") == sorted(((i, len(x)) for i, x in ids.items()), key=repr)
    for r in packing.packing(table, tokenizer=tokens.default_path()).collect():
        own = np.array([*ids[r["doc_id"]], 0], dtype="<u4")
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
    assert {r["component_id"] for r in minhash.near_duplicates(table).collect()} == set(ids)


def test_packing_keeps_full_pieces_apart(spark):
    found = packing.packing(docs(spark, [(1, LONG), (2, LONG), (3, "a b"), (None, words(3000, 8))]), tokenizer=tokens.default_path()).toPandas()
    full = found[found["length"] == 1024]
    assert len(full) > 100 and full["sequence_id"].is_unique and (full["offset"] == 0).all() and (full["sequence_id"] >= packing.FULL_FROM).all()
    rest = found[found["length"] < 1024]
    assert len(rest) <= 4 and (rest["sequence_id"] < packing.FULL_FROM).all()


def test_token_files_refuse_wide_ids(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_ID", 5)
    with pytest.raises(Exception, match="16-bit"):
        token_counts.token_counts(docs(spark, [(1, "some words")]), tokenizer=tokens.default_path()).count()


def test_mixing_with_many_null_and_repeated_ids(spark):
    rows = [(None, words(20, i), "nulls") for i in range(2000)] + [(7, words(20, 5000 + i), "one id") for i in range(2000)] + [(i, words(20, 9000 + i), s) for i in range(500) for s in ("a", "b", "c")]
    sums = {}
    for r in mixing.source_mixing(docs(spark, rows)).collect():
        key = (r["source_size"], r["target"])
        sums[key] = sums.get(key, 0) + r["taken"]
    assert all(abs(taken - target) <= 20 for (_, target), taken in sums.items() if _ == 40_000) and len(sums) >= 3


def test_saved_snapshots_screen_a_new_batch(spark, tmp_path):
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = lambda own: docs(spark, own).select("doc_id", digest.alias("digest"))
    for name, own in (("one", [(1, "a"), (2, "b"), (3, "b")]), ("two", [(4, "c"), (5, None)]), ("none", [])):
        exact_dedup.Snapshot.of(rows(own)).save(str(tmp_path / name))
    new = exact_dedup.classes(rows([(10, "b"), (11, "c"), (12, "d"), (13, ""), (14, "d")]))
    found = {}
    for name in ("one", "two", "none"):
        held = exact_dedup.Snapshot.load(spark, str(tmp_path / name))
        found[name] = sorted((r["last_id"], r["n_rows"]) for r in held.known(new).collect())
    assert found == {"one": [(3, 2)], "two": [(4, 1), (5, 1)], "none": []}


def test_exact_dedup_of_a_hot_text(spark):
    rows = [(i, "the same text") for i in range(1500)] + [(2000 + i, f"text {i % 400}") for i in range(600)] + [(3000 + i, words(9, i)) for i in range(300)]
    want = {}
    for i, t in rows:
        want.setdefault(t, []).append(i)
    found = exact_dedup.exact_dedup(docs(spark, rows))
    assert rows_of(found, "doc_id", "keep_id", "group_size") == sorted(((i, max(want[t]), len(want[t])) for i, t in rows), key=repr)


def test_near_duplicates_with_many_null_ids(spark):
    rows = [(None, words(30, i)) for i in range(1000)] + [(None, words(30, i) + " end") for i in range(1000)] + [(5, words(30, 20_000 + i)) for i in range(300)]
    found = minhash.near_duplicates(docs(spark, rows)).collect()
    assert len(found) == 2300 and {r["component_id"] for r in found} == {None, 5}
    table = docs(spark, rows)
    sketched = minhash.sketched(table, 5).where("node is not null")
    nodes = minhash.representatives(sketched)
    assert minhash.full_sets(table, nodes).count() == 2300  # one text per node, not every text of an id


def test_exact_dedup_keeps_one_of_rows_that_tie_across_tasks(spark):
    rows = [(1, "a"), (2, "b"), (None, "c"), (1, "a"), (None, "c"), (3, "a"), (2, "b"), (4, None), (3, "a"), (5, ""), (5, ""), (6, "once")] * 3
    spread = docs(spark, rows).repartition(7)
    left = exact_dedup.keep_one(runtime.materialize(spread, "spread")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=repr) == sorted([(3, "a"), (2, "b"), (None, "c"), (5, ""), (6, "once")], key=repr)


def test_exact_dedup_lists_are_those_of_each_task(spark):
    table = runtime.materialize(docs(spark, [(i, f"text {i % 5}" if i % 2 else f"own {i}") for i in range(200)]).repartition(6), "docs")
    read = exact_dedup._read(table, "doc_id", "text")
    pairs = read.where("text like 'text%'").select("digest", "part").distinct()
    kept = exact_dedup.listed(read, exact_dedup.PartLists(pairs, "lists"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(200) if i % 2}
    plan = kept.join(read.select("digest").distinct(), "digest")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("among") == 1  # not applied to what the rows are joined with


#: Two words that collide under the hash without a key.
TWINS = ("!+?6*9(j!@!\"-@!!", "<2}'-dng'c)#@`m2")


def test_words_that_collide_without_a_key_are_told_apart(spark):
    raw, offsets = runtime.text_buffer(pa.array(list(TWINS)))
    plain, keyed = (runtime.Words(raw, offsets, runtime.NOT_SPACE).hashes(key=k) for k in (0, runtime.new_key()))
    assert plain[0] == plain[1] and keyed[0] != keyed[1]
    texts = [f"one two {a} three {b} four" for a in TWINS for b in TWINS] + [" ".join(TWINS), "x" * 600 + " " + "y" * 600]
    encode, plain_ids = tokens.Encoder(tokens.default_path()), tokens.Encoder(tokens.default_path()).slow
    ids, counts = encode.batch(pa.array(texts))
    assert np.split(ids, np.cumsum(counts)[:-1]) and ids.tolist() == [i for t in texts for i in plain_ids.encode(t, add_special_tokens=False).ids]
    rows = [(i, f"{words(8, i)} {w} {words(8, 50 + i)}") for i in range(3) for w in TWINS]  # a third of the shingles differ
    found = minhash.near_duplicates(docs(spark, [(2 * i + TWINS.index(t.split()[8]), t) for i, t in rows])).collect()
    assert all(r["kept"] for r in found) and len(found) == 6


def test_mixing_cuts_within_equal_rows(spark):
    text = words(7, 1)
    rows = [(None, text, "copies") for _ in range(900)] + [(i, words(1 + i % 30, i), "other") for i in range(800)] + [(i, words(3, i), None) for i in range(40)]
    table = runtime.materialize(docs(spark, rows).repartition(5), "docs")
    found = mixing.source_mixing(table).collect()
    by = {}
    for r in found:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 30  # half of the longest text and what the last hash holds
    copies = [r["taken"] for r in found if r["doc_id"] is None and r["size"] == 7]
    assert abs(sum(copies) - next(r["target"] for r in found if r["size"] == 7 and r["doc_id"] is None)) <= 3.5 and len(set(copies)) == 2
    again = sorted((r["doc_id"], r["size"], r["taken"]) for r in mixing.source_mixing(table).collect() if r["doc_id"] is not None)
    assert again == sorted((r["doc_id"], r["size"], r["taken"]) for r in found if r["doc_id"] is not None)
    copied = mixing.mixed(table)
    assert copied.columns == table.columns
    words_of = copied.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()
    assert sorted(r["n"] for r in words_of) == sorted(sum(t) for t in by.values())
