"""The training-data operators against brute force, on awkward small tables."""

import hashlib
import itertools
import random
import re
import zlib

import base64
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from vaporlog.llm import bpe, exact_dedup, html_text, licenses, line_dedup, ngram_join, packing, quality_rules, rank_queue, toxicity, warc
from vaporlog.llm.queries import ORACLE, QUERIES
from verification.compare import differences

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, recipe string, node long, host string"


@pytest.fixture
def docs(spark):
    """Build documents from (id, text) pairs, with columns whose names the operators use themselves."""

    def build(*rows, source="s"):
        return spark.createDataFrame([(i, t, None, source, None, "x", 1, None) for i, t in rows], SCHEMA)

    return build


def word_text(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()):
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


ODD = [(1, None), (2, ""), (3, "   "), (4, "one"), (4, "one"), (None, "no id at all"), (5, "x" * 60_000), (6, "a\n\na\n b \na")]


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    assert differences(QUERIES[name](spark, FOLDER).toPandas(), connection.execute(ORACLE[name]).df()) == []


# exact deduplication

def test_exact_groups(docs):
    got = exact_dedup.exact_groups(docs(*ODD, (7, "one"), (8, "One"))).toPandas()
    rows = {(r.doc_id, r.text_sha256): r for r in got.itertuples() if r.doc_id == r.doc_id}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == 10 and rows[1, sha("")].keep_id == 2 and not rows[1, sha("")].kept
    assert rows[4, sha("one")].keep_id == 7 and rows[4, sha("one")].group_size == 3
    assert rows[8, sha("One")].kept and rows[5, sha("x" * 60_000)].kept
    assert exact_dedup.exact_groups(docs()).count() == 0


def test_drop_copies_keeps_one(docs):
    kept = exact_dedup.drop_copies(docs((1, "a"), (2, "a"), (3, "b"), (3, "b"), (3, "c"), (9, None))).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(2, "a"), (3, "b"), (3, "c"), (9, None)], key=str)
    assert kept[0].recipe == "x"


# quality rules

def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(docs):
    rng = random.Random(3)
    texts = [t for _, t in ODD] + ["a b c a b c", "a b a b a b a", "a b c\x0bd\x0ce f # é", "#*$ %&|<>"] + [
        word_text(rng, 60, ["a", "b"]) for _ in range(5)
    ]
    got = quality_rules.judge(docs(*enumerate(texts))).toPandas().set_index("doc_id")
    for i, text in enumerate(texts):
        row = got.loc[i]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == brute_measures(text)
        assert row.base_failed == (row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words)
    assert quality_rules.judge(docs()).count() == 0


def test_bad_host_goes_with_all_documents(docs):
    rng = random.Random(4)
    good = [(i, word_text(rng, 80)) for i in range(40)]
    bad = [(100 + i, "too short") for i in range(60)] + [(200, word_text(rng, 80))]
    frame = docs(*good, source="fine").unionByName(docs(*bad, source="junk")).unionByName(docs((300, word_text(rng, 80)), source=None))
    kept = {r.doc_id for r in quality_rules.keep_good(frame).collect()}
    assert kept == {i for i, _ in good} | {300}


# toxicity

def test_toxicity_separates_held_out_rows(spark, docs):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        words = word_text(rng, 60).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["grobian", "vexling", "you moron"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    table = spark.createDataFrame([*labels, (5000, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs(*rows, (None, "x"), (9001, None)), table).toPandas()
    held = got[got.held_out]
    assert len(got) == 902 and got.score.between(0, 1).all() and set(held.doc_id) >= {
        i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0
    }
    wrong = [r for r in held.itertuples() if r.doc_id < 900 and r.predicted != (r.doc_id % 4 == 0)]
    assert len(wrong) <= 0.03 * len(held)


def test_toxicity_without_labels(spark, docs):
    table = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.score(docs(*ODD), table).collect()} == {(0.0, 0)}
    assert toxicity.score(docs(), table).count() == 0


# n-gram join

def brute_components(rows, length, num, den):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i:i + length]) for i in range(max(1, len(words) - length + 1))} if words else set()

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {(i, len(s), None if i is None else find(i)) for i, s in sets}


def test_ngram_components(docs):
    rng = random.Random(6)
    rows, n = list(ODD), 10
    common = word_text(rng, 40)
    for _ in range(25):
        words = word_text(rng, rng.choice([8, 30, 120])).split()
        base = words if rng.random() < 0.5 else words + common.split()
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word_text(rng, 1)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n + 1, "Short TEXT"), (n + 2, "short text"), (n + 3, "short")]
    for length, num, den in ((4, 85, 100), (5, 4, 5)):
        got = ngram_join.similar_components(docs(*rows), length, num, den).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(rows, length, num, den)
        assert len(got) == len(rows)
    assert ngram_join.similar_components(docs()).count() == 0
    kept = ngram_join.drop_near_copies(docs((1, "a b c d e f"), (2, "A b c d e f"), (3, "z"), (4, None))).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4]


# tokens

def vocabulary(name):
    return rank_queue.read_ranks(public_tokenizers.path(name))


def test_rank_queue_equals_tiktoken(docs):
    ranks = vocabulary(bpe.RANKS)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    texts = ["a \nb", "\n a", "a\n \nb", "x<|endoftext|> y", "don't  we'll 12\t\tq\x85   z", "ab" * 3000, "é" * 500, "a  "]
    texts += ["".join(rng.choice("ab '\n\t s1.é 中") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [*ODD, *enumerate(texts, 100)]
    got = bpe.encode_texts(docs(*rows)).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), library.encode_ordinary(t or "")) for i, t in rows)
    trip = bpe.round_trip(docs(*rows)).collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in trip) == sorted(
        (str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows
    )
    back = bpe.decode_texts(bpe.encode_texts(docs((1, "é中 x"), (2, None)))).collect()
    assert {r.doc_id: bytes(r.data).decode() for r in back} == {1: "é中 x", 2: ""}


def test_packing(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))  # the plain call: a special token's string is that token
    rng = random.Random(8)
    rows = [*ODD, *[(10 + i, word_text(rng, rng.choice([3, 40, 200, 900]))) for i in range(120)], (500, "<|endoftext|>")]
    got = packing.pack_documents(docs(*rows)).toPandas()
    pieces = set()
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at, k, piece = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            pieces.add((i, piece, at, k, zlib.crc32(np.array(ids[at:at + k], "<u4").tobytes())))
            at, k, piece = at + k, 1024, piece + 1
    found = {(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()}
    assert found == pieces
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum()[:-1]] and sequence.length.sum() <= 1024
    assert got.sequence_id.nunique() <= 1.02 * -(-got.length.sum() // 1024) + 1
    assert packing.pack_documents(docs()).count() == 0


def test_exchange_and_bounds(spark):
    rng = np.random.default_rng(9)
    lengths = rng.integers(200, 700, 4000)
    pieces = spark.createDataFrame([(int(i), 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES.format(kind="long"))
    alone = packing.pack(pieces, 1024, rounds=1, partition_pieces=500).toPandas()
    exchanged = packing.pack(pieces, 1024, rounds=3, partition_pieces=500).toPandas()
    assert sorted(exchanged.doc_id) == list(range(4000)) and exchanged.sequence_id.nunique() <= alone.sequence_id.nunique()
    assert exchanged.groupby("sequence_id").length.sum().max() <= 1024
    for size, lengths in ((10, [6, 6, 6, 4, 4]), (10, [4, 4, 4, 4]), (9, [5, 5, 3, 3, 3]), (7, [7, 1])):
        lengths = np.array(lengths)
        least = min(
            len(set(p)) for p in itertools.product(range(len(lengths)), repeat=len(lengths))
            if all(sum(lengths[i] for i in range(len(lengths)) if p[i] == b) <= size for b in set(p))
        )
        assert packing.lower_bound(lengths, size) <= least <= len(packing.best_fit(lengths, size)[2])


# lines

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, line, edits):
    line = list(line)
    for _ in range(edits if line else 0):
        at, kind = rng.randrange(len(line) or 1), rng.randrange(3)
        line[at:at + (kind != 1)] = [] if kind == 0 else [rng.choice("abcdef")]
    return "".join(line)


def test_banded_distance():
    rng = random.Random(10)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
        b = edited(rng, a, rng.randrange(4)) if rng.random() < 0.7 else "".join(rng.choice("abc") for _ in range(rng.randrange(14)))
        for edits in range(4):
            assert line_dedup.within(a, b, edits) == (distance(a, b) <= edits), (a, b, edits)


def test_lines(docs):
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcdef ") for _ in range(rng.choice([5, 19, 25, 45, 70]))).strip() or "q" for _ in range(30)]
    pool += [edited(rng, line, rng.choice([1, 1, 2, 3])).strip() or "q" for line in pool for _ in range(2)]
    rows = [*ODD, *[(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for i in range(20, 60)]]
    lines = sorted({x.strip() for _, t in rows for x in (t or "").split("\n") if x.strip()})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(lines, 2):
        limit = line_dedup.threshold(min(len(a), len(b)))
        if limit and abs(len(a) - len(b)) <= limit and distance(a, b) <= limit:
            root[find(b)] = find(a)
    got = line_dedup.repeated_lines(docs(*rows)).collect()
    hashes = {(r.doc_id, r.n_lines): r for r in got}
    assert len(got) == len(rows) and hashes[None, 1].dropped == []
    order = sorted({(r.doc_id is not None, r.doc_id or 0, t or "") for r in got for i, t in rows if i == r.doc_id})
    seen, equal, want = {}, set(), {}
    for _, i, text in order:  # ids with several texts are equal here, so hashes do not matter
        for k, line in enumerate(text.split("\n")):
            line = line.strip()
            if not line:
                continue
            if find(line) in seen:
                want.setdefault(i, []).append((k, *seen[find(line)], line in equal))
            else:
                seen[find(line)] = (i, k)
            equal.add(line)
    for r in got:
        if r.doc_id is None:
            continue
        expected = want.get(r.doc_id, [])
        assert [(d.line, d.first_doc, d.first_line) for d in r.dropped] == [e[:3] for e in expected]
        assert (r.n_equal, r.n_near) == (sum(e[3] for e in expected), sum(not e[3] for e in expected))
    assert line_dedup.repeated_lines(docs()).count() == 0
    left = line_dedup.drop_repeated_lines(docs((1, "a\nb\na"), (2, "b\n\nc"), (3, None))).collect()
    assert {r.doc_id: r.text for r in left} == {1: "a\nb", 2: "\nc", 3: None}


def test_long_lines_are_near_by_their_length(spark):
    rng = random.Random(14)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (99, 100, 104, 131, 190, 260, 411, 640)]
    lines = ["x" * 300, "x" * 310, "ab" * 200] + pool
    for line in pool:
        limit = len(line) // 20
        lines += [edited(rng, line, k) for k in (3, limit - 1, limit, limit + 1, 2 * limit)]
        step = list(line)
        step[10::20] = ["#"] * len(step[10::20])  # edits as far apart as they can be
        lines += ["".join(step), line + "+" * limit, line[limit:], "+" * (limit + 1) + line]
    table = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    root = {i: i for i in range(len(lines))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(lines), 2):
        limit = min(len(a), len(b)) // 20
        if abs(len(a) - len(b)) <= limit and distance(a, b) <= limit:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    linked = {find(i) for i in root if find(i) != i}
    assert len(linked) >= len(pool)
    got = {r.node: r.root for r in line_dedup.line_classes(table).collect()}
    assert got == {i: find(i) for i in root if find(i) in linked}
    for a, b in itertools.combinations(lines[:14], 2):
        for edits in (0, 10, 40, 300):
            assert line_dedup.within(a, b, edits) == (distance(a, b) <= edits)


# licenses

def test_licenses(docs):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("including without limitation", "including, with no limits,").replace("sublicense, and/or sell", "and sell")
    rows = [*ODD, (20, f"Intro.\n{mit}\nEnd"), (21, f"é {changed}"), (22, "Released under the MIT License."), (23, "the license of a car")]
    got = {(r.doc_id, r.license): r for r in licenses.scan_licenses(docs(*rows)).collect()}
    assert set(got) == {(20, "MIT"), (21, "MIT"), (22, "MIT-line")}
    assert got[20, "MIT"].coverage == 1.0 and 0.8 < got[21, "MIT"].coverage < 1.0
    assert got[22, "MIT-line"].matched == "Released under the MIT License" and rows[-2][1][0:30] == got[22, "MIT-line"].matched
    assert licenses.scan_licenses(docs()).count() == 0


def test_whole_license_texts(docs):
    whole = list(licenses.TEMPLATES)
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "BSD-3-Clause"} <= set(whole)
    rows = [(i, f"Before. {licenses.TEMPLATES[name]}") for i, name in enumerate(whole)]
    got = licenses.scan_licenses(docs(*rows)).collect()
    assert sorted((r.doc_id, r.license) for r in got) == list(enumerate(whole))
    for r in got:
        text = dict(rows)[r.doc_id]
        words = list(re.finditer(r"[A-Za-z0-9\u0080-\U0010FFFF]+", text))
        assert (r.coverage, r.span_start, r.span_end) == (1.0, words[1].start(), words[-1].end())
    assert next(r for r in got if r.license == "MIT").matched.endswith("DEALINGS IN THE SOFTWARE")
    assert len(licenses.TEMPLATES["GPL-3.0"].split()) > 5000


def test_license_places_near_each_other():
    line = "Released under the MIT License."
    scan = licenses.Scanner({"MIT-line": line}).scan
    for n in (1, 2, 3, 5):
        text = " ".join([line] * n)
        assert [(m[0], m[1], m[2]) for m in scan(text, 0.6)] == [("MIT-line", 1.0, k * (len(line) + 1)) for k in range(n)]
    # a chance hit a few words before the true start, and inserted words that need the whole band
    words = [f"w{i}" for i in range(40)]
    copy = [*words[:20], *[f"new{i}" for i in range(8)], *words[20:]]
    for before in range(1, 8):
        text = " ".join([*words[:3], *["x"] * before, *copy])
        assert max(m[1] for m in licenses.Scanner({"t": " ".join(words)}).scan(text, 0.6)) == 1.0


def test_alignment_equals_longest_common_subsequence():
    rng = random.Random(12)
    for _ in range(200):
        text = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 12))], "uint64")
        template = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 12))], "uint64")
        row = [0] * (len(template) + 1)
        for x in text:
            last = 0
            for j, y in enumerate(template, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert licenses.align(text, template, 0, 20)[0] == row[-1]


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies, dear reader, to make this better.</div><article><h1>Tea &amp; milk</h1><p>First <b>bo</b>ld
 text.<p>Second&nbsp;one<br>goes on.</p><form><input><p>Your mail</p></form><p>Ok.</p><div class='ad'>Buy now!</div></article>
<section id="comments"><p>Great article, I liked every word of it a lot indeed.</p></section><aside>More</aside><footer>&copy; me</footer>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "plain words &lt;b&gt; only"), (4, "w", "<p>a<p>b<script>x</script>"), (5, "z", "<div>" * 5000 + "deep")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    texts = sorted((r.page_id, r.text, r.n_chars) for r in got.collect())
    assert texts[0][1] == "Tea & milk First bold text. Second one goes on. Ok."
    assert [t[1] for t in texts[1:]] == ["", "", "a b", "plain words <b> only", "deep"] and all(len(t) == n for _, t, n in texts)
    assert html_text.extract(got.limit(0).withColumnRenamed("text", "html")).count() == 0


def test_archives(spark, tmp_path):
    long = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 200
    rows = [(3, "http://a/ b\r\nX: y", long), (1, "u", long), (2, None, long), (4, "u", "short"), (5, "u", "short"), (6, None, None), (1, "u", long), (None, "n", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path, contents=True).collect()
    assert len(records) == len(rows) and {bytes(r.content) for r in records if r.record_type == "response"} == {long.encode(), b"short", b""}
    got = warc.archive_round_trip(pages).collect()
    kinds = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got)
    size = len(long.encode())
    assert kinds == sorted([
        ("1", size, "response", None), ("1", size, "response", None), ("2", size, "revisit", 1), ("3", size, "revisit", 1),
        ("None", size, "revisit", 1), ("4", 5, "response", None), ("5", 5, "response", None), ("6", 0, "response", None),
    ])
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


# pipeline

def test_pipeline(spark, docs, tmp_path):
    rng = random.Random(13)
    texts = [word_text(rng, 70) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[5]), (101, texts[6] + " extra"), (102, "short"), (103, None), (104, "a b c " * 40)]
    folder = str(tmp_path)
    docs(*rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {i for i in range(60) if i != 5} | {100}
    frame, names = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        names.append(name)
        kept = stage(spark, frame, folder)
        assert name == "best_fit_packing" or kept.columns == frame.columns
        frame = kept
    assert names == ["quality_rules", "toxicity", "exact_dedup", "ngram_join", "best_fit_packing"]
