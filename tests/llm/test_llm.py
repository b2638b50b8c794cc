"""Dealt operators against brute force, SQL and round trips, and on awkward rows."""

import os
import hashlib
import re
import zlib
from collections import Counter
from functools import reduce
from operator import add, mul

import duckdb
import numpy as np
import pytest

pytest.importorskip("offerloom.llm")

import corpus_pipeline
import oracle
from offerloom.llm import common, encode, exact_topk, jaccard_join, language_id, line_dedup, mixing, nearest, packing, pii, quality, records
from offerloom.llm.bindings import QUERIES
from offerloom.llm.components import components

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, size int, `class` long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing column names."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "one", None, "b", 3),
        (5, "same text with a few words in it", "en", "a", 1), (5, "same text with a few words in it", "en", "a", 1),
        (6, "same text with a few words in it", "en", None, 1), (7, long, "en", "a", 1), (None, "no id, mail me@x.org", "de", "b", 1),
        (8, "1234 !!! ???", "en", "b", 1), (9, "same  text\nwith a few words in it", "fr", "c", 1),
    ]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in common.documents(spark, FOLDER).collect()}


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_sql(spark, name):
    rows, problems = oracle.compare(spark, oracle.connect(FOLDER), FOLDER, QUERIES[name].run, QUERIES[name].sql)
    assert problems == [] and rows > 0


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_give_the_library_ids(name, spaces):
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["", " ", "  ", "a  b", "a   b  c ", "a\n \nb", "It's o'k", "<|endoftext|> x", "a <|endoftext|>", "it<|endoftext|>'s <|startoftext|>. b",
             "a  <|endoftext|>  b", " <|endoftext|> ", "x" * 3000 + "=" * 400 + " b", "\x01 \x1c a", "Σας ΑΣ Σ", "é ́", None, "9\r\n z—1"]
    tool = encode.ChunkEncoder(common.tokenizer_path(name), spaces, memo_entries=5)
    own = Tokenizer.from_file(common.tokenizer_path(name))
    for _ in range(2):
        ids, bounds = tool.encode(pa.array(texts))
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == own.encode(text or "", add_special_tokens=False).ids
    assert max(map(len, tool.memo)) <= encode.MEMO_CHARS


def test_token_files_round_trip(spark, docs, odd, empty):
    tool = encode.ChunkEncoder(common.tokenizer_path("byte_bpe_50k.json"), True).tokenizer
    got = {r.doc_id: r for r in QUERIES["op9_token_records"].run(spark, FOLDER).collect()}
    at = 0
    for doc_id in sorted(docs):
        ids = np.array(tool.encode(docs[doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        assert got[doc_id][1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = common.tokenizer_path("byte_bpe_50k.json")
    assert records.token_file_digest(spark, odd, path, True).count() == 11
    assert records.token_file_digest(spark, empty, path, True).count() == 0


def test_damaged_record_is_an_error():
    good = records.frame(records.to_payload(7, np.arange(5, dtype=np.uint16)))
    assert records.from_payload(records.unframe(good, 0)[0])[0] == 7
    for place in (0, 14, len(good) - 1):
        with pytest.raises(ValueError):
            records.unframe(good[:place] + bytes([good[place] ^ 1]) + good[place + 1 :], 0)


def test_packing(spark, odd, empty):
    path = common.tokenizer_path("word_bpe_49k.json")
    for table in (common.documents(spark, FOLDER), odd):
        rows = packing.pack_documents(table, path, False).collect()
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= packing.CAPACITY
        assert len(by) <= 1.05 * sum(r.length for r in rows) / packing.CAPACITY + 1
        assert sum(r.piece == 0 for r in rows) == table.count()
    assert packing.pack_documents(empty, path, False).count() == 0


def test_sequences_hold_the_ids(spark):
    path = common.tokenizer_path("word_bpe_49k.json")
    table = common.documents(spark, FOLDER)
    pieces = common.staged(packing.cut_documents(table, path, False, with_ids=True), "test-pieces")
    placed = common.staged(packing.place(pieces, ["doc_id", "piece"]), "test-placed")
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u2") for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert zlib.crc32(whole[r.sequence_id][r.offset : r.offset + r.length].astype("<u4").tobytes()) == r.ids_crc32


def shingle_set(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def test_jaccard_against_all_pairs(spark, docs, odd, empty):
    for table, k, num, den in ((common.documents(spark, FOLDER), 4, 85, 100), (odd, 5, 4, 5)):
        rows = [(r.doc_id, r.text) for r in table.collect() if r.doc_id is not None]
        sets = {i: shingle_set(t, k) for i, t in rows}
        root = {i: i for i in sets}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a in sorted(sets):
            for b in sorted(sets):
                if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        got = jaccard_join.jaccard_components(table, k, num, den).collect()
        assert len(got) == table.count()
        for r in got:
            if r.doc_id is not None:
                assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))
    assert jaccard_join.jaccard_components(empty, 4, 85, 100).count() == 0


@pytest.mark.parametrize("k, num, den", [(4, 85, 100), (5, 4, 5)])
def test_jaccard_of_texts_that_lack_the_last_word(spark, k, num, den):
    """Linking sets whose smaller one shows few first elements, such as 7 and 6, or 5 and 4."""
    texts = [" ".join(f"t{n}w{i}" for i in range(n)) for n in range(k + 1, 40)]
    rows = [(2 * i, t) for i, t in enumerate(texts)] + [(2 * i + 1, t.rsplit(" ", 1)[0]) for i, t in enumerate(texts)]
    sets = {i: shingle_set(t, k) for i, t in rows}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for r in jaccard_join.jaccard_components(table, k, num, den).collect():
        a, b = sets[r.doc_id & ~1], sets[r.doc_id | 1]
        linked = den * len(a & b) >= num * len(a | b)
        assert r.component_id == (r.doc_id & ~1 if linked else r.doc_id)


def test_small_sets_meet_in_subsets():
    a, b = np.arange(1, 9, dtype=np.uint64), np.arange(2, 9, dtype=np.uint64)
    assert set(jaccard_join.subset_keys(a, 85, 100)) & set(jaccard_join.subset_keys(b, 85, 100))
    assert len(jaccard_join.subset_keys(a, 85, 100)) == jaccard_join.subset_count(8, 85, 100)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 52), (52, 51), (60, 60)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50, 52: 50}


def test_lines(spark, empty):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    rows = [(2, f"{text}\nkept one two three\n\n..."), (1, f"intro line here\n{text.upper()}!"), (3, f"x\n{text}"), (4, None), (5, "")]
    table = spark.createDataFrame([(*r, "en", "s", 9, 1, 1, 1) for r in rows], DOCS)
    got = {r.doc_id: r for r in line_dedup.without_repeated_lines(table).collect()}
    assert got[1].text == rows[1][1] and got[2].text == "kept one two three\n\n..." and got[3].text == "x"
    assert got[4].text is None and (got[4].n_lines, got[5].n_lines, got[5].text) == (0, 1, "")
    assert [got[i].n_dropped for i in (1, 2, 3)] == [0, 1, 1]
    assert line_dedup.without_repeated_lines(empty).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_edited_lines_against_all_pairs(spark):
    """Of linking pairs of lines, short ones are all found and 98 % of those with edited words."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9)))
    rows = []
    for n in range(240):
        line = [word() for _ in range(3 + n % 38)]
        other = list(line)
        for _ in range(1 + n // 120):
            other[rng.integers(len(other))] = word()
        letters = list(" ".join(line))
        if n % 3 == 0 and len(letters) <= line_dedup.SHORT:
            for _ in range(len(letters) // 10):
                at = rng.integers(len(letters))
                letters[at : at + 1] = [[], ["z"], [letters[at], "z"]][rng.integers(3)]
            other = "".join(letters).split()
        rows += [(2 * n, " ".join(line)), (2 * n + 1, " ".join(other))]
    lines = dict(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.without_repeated_lines(table).collect()}
    found = {True: [], False: []}
    for n in range(240):
        a, b = lines[2 * n], lines[2 * n + 1]
        if a != b and 10 * edits(a, b) <= max(len(a), len(b)):
            found[max(len(a), len(b)) <= line_dedup.SHORT].append(got[2 * n + 1])
        elif a != b:
            assert got[2 * n + 1] == 0
    print("recall", {k: (sum(v), len(v)) for k, v in found.items()})
    assert len(found[True]) >= 20 and all(found[True])
    assert len(found[False]) > 100 and np.mean(found[False]) >= 0.98


def test_short_lines_and_lines_without_spaces(spark):
    rows = ["Ok\nSign in\n---\n\n。。", "sign in!\n我们今天去公园散步\nab", "ok\n我们今天去公园散步\n---\n\n。。\n我们明天去公园"]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(table).collect()}
    assert got == {0: rows[0], 1: "我们今天去公园散步\nab", 2: "---\n\n。。\n我们明天去公园"}


def test_lines_name_no_key_and_normalise_no_more_than_needed(spark):
    """Short lines meet by segments alone, and rows are normalised once."""
    rows = [(1, "a short line of words\nanother one, of fifty-six characters and no more x y z"), (2, "word " * 12 + "end")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_dedup.distinct_lines(table)
    lengths = {r.h: r.len for r in lines.collect()}
    named = {r.h for r in line_dedup.line_keys(lines).where("info >= 0").collect()}
    assert {lengths[h] for h in named} == {n for n in lengths.values() if n > 56} and min(lengths.values()) < 57
    plan = line_dedup.line_rows(table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    texts = ["a" * 24, "b " + "c" * 24 + " d", "c" * 23 + " " + "d" * 23, "e \u0e01\u0e02", "plain words"]
    found = spark.createDataFrame([(t,) for t in texts], "norm string")
    got = [r[0] for r in found.select(line_dedup._tokens("norm")).collect()]
    assert [len(t) for t in got] == [24, 26, 2, 3, 2]


def test_long_lines_have_the_same_edit_bound(spark):
    body = "alpha " * 1_500
    near = [body + " ".join(f"{c}{i:03}" for i in range(140)) for c in ("bbb", "xyz")]
    far = body + " ".join(f"qrst{i:05}" for i in range(250))
    table = spark.createDataFrame([(i, x) for i, x in enumerate([*near, far])], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.without_repeated_lines(table).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_lines_move_in_parts_whose_shuffles_go(spark, monkeypatch):
    """Keys move by kind and texts in rounds; no shuffle outlives the action that made it, and no result changes."""
    import time

    rows = [(i, f"{'first' * (i % 7)} line of text with words {i // 2} and more of them to pass the bound of short ones\nshort {i % 3}") for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, line_dedup.without_repeated_lines(table).collect()))
    assert 0 < sum(r[3] for r in want) < 24
    blocks, written = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), []

    def files():
        return set(blocks.getAllFiles().mkString("|").split("|"))

    def noted(df, name, **options):
        found = common.staged(df, name, **options)
        written.append(name)
        return found

    monkeypatch.setattr(line_dedup, "staged", noted)
    monkeypatch.setattr(line_dedup, "ROUND_CHARS", 1_000)
    before = files()
    gone = line_dedup.without_repeated_lines(table)
    for _ in range(50):
        left = {f for f in files() - before if "shuffle_" in f}
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert written.count("line-listed") == 3 and written.count("line-links") > 2
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert sorted(map(tuple, gone.collect())) == want


def test_lines_at_a_common_run_are_no_pairs(spark, monkeypatch):
    """Lines that share one common run do not become pairs; those that share two such runs meet."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    rows = []
    for n in range(200):
        first = ["usualaa", "usualbb", "usualcc"] if n < 120 else [word() for _ in range(3)]
        last = ["usualdd", "usualee", "usualff"] if n >= 80 else [word() for _ in range(3)]
        rows.append((n, " ".join([*(word() for _ in range(2)), *first, *(word() for _ in range(2)), *last, *(word() for _ in range(2))])))
    # Of one line an edit is in a word, of another one in every word beside the two common runs.
    rows.append((200, rows[3][1][:-1] + "é"))
    rows.append((201, " ".join(w if w.startswith("usual") else w[:3] + "é" + w[4:] for w in rows[100][1].split())))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    asked, possible = [], line_dedup._possible

    def noted(lines, pairs):
        asked.append(pairs.count())
        return possible(lines, pairs)

    monkeypatch.setattr(line_dedup, "_possible", noted)
    got = {r.doc_id: r.n_dropped for r in line_dedup.without_repeated_lines(table).collect()}
    assert {i for i, n in got.items() if n} == {200, 201}
    assert 200 < sum(asked) < 2_000, asked


def test_lines_at_a_common_passage_meet(spark):
    """Where many lines share all but a few runs, links between them are found."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    usual = " ".join(word() for _ in range(6))
    rows = [(n, " ".join([word(), word(), word(), usual, word(), word(), word()])) for n in range(90)]
    rows.append((90, " ".join(w if w in usual.split() else w[:3] + "é" + w[4:] for w in rows[50][1].split())))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.without_repeated_lines(table).collect()}
    assert {i for i, n in got.items() if n} == {90}


def test_lines_leave_few_staged_rows(spark, monkeypatch):
    """Rows of keys and pairs go after the last step that reads them; keys of blocks are listed in rounds."""
    rows = [(i, f"{'first' * (i % 7)} line of text with words {i // 2} and more of them to pass the bound of short ones\nshort {i % 3}") for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want, left = sorted(map(tuple, line_dedup.without_repeated_lines(table).collect())), {}

    def noted(df, name, **options):
        found = common.staged(df, name, **options)
        left.setdefault(name, []).extend({f.rsplit("/", 1)[0].removeprefix("file:") for f in found.inputFiles()})
        return found

    monkeypatch.setattr(line_dedup, "staged", noted)
    monkeypatch.setattr(line_dedup, "ROUND_ROWS", 8, raising=False)
    assert sorted(map(tuple, line_dedup.without_repeated_lines(table).collect())) == want
    for name in ("line-simhashes", "line-listed", "line-possible", "line-asked-texts"):
        assert left[name] and not any(map(os.path.exists, left[name])), name
    assert len(left["line-listed"]) > 3


def test_lines_against_plain_version(spark, docs):
    """Exact copies all go but one; links lead from every line that is lost to a kept one."""
    norm = lambda x: " ".join(re.findall("[a-z0-9\u0080-\U0010ffff]+", x.lower()))
    kept, seen = {}, {}
    for r in QUERIES["op3_line_dedup"].run(spark, FOLDER).collect():
        for line in r.text.split("\n"):
            kept[norm(line)] = kept.get(norm(line), 0) + 1
        for line in docs[r.doc_id].split("\n"):
            seen[norm(line)] = True
    for line in seen:
        if len(line.split()) >= line_dedup.MIN_WORDS:
            assert kept.get(line, 0) <= 1
    distance = duckdb.connect()
    bags = {line: Counter(line) for line in seen}

    def linked(a, b):
        most = max(len(a), len(b)) // line_dedup.EDIT_SHARE
        if abs(len(a) - len(b)) > most or (bags[a] - bags[b]).total() > most or (bags[b] - bags[a]).total() > most:
            return False
        return distance.execute("SELECT levenshtein(?, ?)", [a, b]).fetchone()[0] <= most

    reached, lost = set(seen) & set(kept), {line for line in seen if line and line not in kept}
    while lost:
        near = {line for line in lost if any(linked(line, other) for other in reached)}
        assert near, sorted(lost)[:3]
        reached, lost = near, lost - near


def test_mixing(spark, odd, empty):
    rows = mixing.mixed_sizes(odd).collect()
    assert len(rows) == 11 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mixed_sizes(odd).collect()))
    assert mixing.mixed_sizes(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if low <= len(digits) <= high and (kind == 3 or pii.luhn(digits)):
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans(spark, docs, odd, empty):
    tricky = ["a@b.c@d.e", "x" * 9000 + "@y.z", "a@b@c.de.", "..@a.b", "4111 1111 1111 1111", "+1 (274) 555-9629 1.2.3.4.5", "@", "é@a.b a@é.b",
              "1.2.3.4", "1.2.3", "a1.2.3.4b 300.1.1.1.1.1.1.1", "000255.01.0.00 1..2.3.4.5.6", "1.2.3.4.5.6.7.8.9", "٣1.2.3.4"]
    for text in [*docs.values(), *tricky]:
        assert pii.base_spans(text) == base(text)
    assert pii.base_spans("7" * 1_000_000) == [] and pii.base_spans("1.2." + "9" * 9_000 + ".3") == []
    assert pii.base_spans("1.2." + "0" * 9_000 + "9.3") == [(0, 1, 9_007)]
    assert pii.personal_data(odd).count() == 11 and pii.personal_data(empty).count() == 0
    one = [r for r in pii.personal_data(odd).collect() if r.doc_id is None][0]
    assert one.n_email == 1 and one.base_sha256 == hashlib.sha256(one.spans.encode()).hexdigest()


def test_contexts_find_new_identifiers(spark):
    rows = [(i, f"please call number +1 (555) 201-{1000 + i} today") for i in range(12)] + [(99, "please call number 77-88-99-00 today")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(table).collect()}
    assert got[99].n_phone == 0 and got[99].spans == "phone:19:30"


def test_bootstrapping_ends_when_nothing_is_new(spark):
    """Pattern r holds four to the power of 5 - r instances and those of the next one."""
    groups, rows, low = [], [], 0
    for r in range(6):
        groups.append(range(low, low + 4 ** (5 - r)))
        low += 4 ** (5 - r)
    for r in range(5):
        rows += [(f"p{r}", i, 3 if r == 0 and i in groups[0] else None) for i in [*groups[r], *groups[r + 1]]]
    found = pii.bootstrap(spark.createDataFrame(rows, "pattern string, instance long, kind int")).collect()
    assert sorted(r.instance for r in found) == [i for g in groups[1:] for i in g]


def test_contexts_at_the_start_of_a_text(spark):
    rows = [(i, f"+1 (555) 201-{1000 + i} reached us") for i in range(12)] + [(99, "77-88-99-00 reached us")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.personal_data(table).collect()}[99] == "phone:0:11"


def test_vectors_with_awkward_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (50, [1.0, 0.5]), (100, [0.5, 0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]),
            (4, [0.0, 0.0]), (5, [1.0]), (6, []), (None, [1.0, 1.0]), (7, [0.9, 0.1]), (7, [0.9, 0.1])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int")
    near = nearest.self_nearest(table).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in near] == [20, 50, 7, 7, 100]
    exact = exact_topk.self_search(table).where("query_id = 0").orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in exact] == [(20, 65536), (50, 65536), (7, 58880), (7, 58880), (100, 32768)]
    assert nearest.self_nearest(table.limit(0)).count() == 0 and exact_topk.self_search(table.limit(0)).count() == 0


def test_large_and_uneven_components(spark):
    """Scores beyond 2 ** 53 are whole; rows of very unlike sizes and copies of one vector meet."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * 10.0 ** rng.integers(-3, 7)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)] + [(2000 + i, rng.normal(size=4).tolist()) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    for every, k, search, value in (
        (50, 5, exact_topk.self_search, lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b]))),
        (20, 20, nearest.self_nearest, lambda a, b: reduce(add, map(mul, dict(rows)[a], dict(rows)[b]), 0.0)),
    ):
        got = {}
        for r in search(table).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for q in [i for i, _ in rows if i % every == 0]:
            others = [(value(q, i), i) for i, v in rows if i != q and len(v) == len(dict(rows)[q])]
            best = sorted(others, key=lambda x: (-x[0], x[1]))[:k]
            assert sorted(got[q]) == [(n + 1, i, score) for n, (score, i) in enumerate(best)]


def test_cells_bound_every_score():
    rng = np.random.default_rng(5)
    data = rng.normal(size=(200, 16)) * 10.0 ** rng.integers(-4, 9, (200, 1))
    for codec, exact in ((exact_topk.Cells, lambda x: np.floor(256 * x)), (nearest.TileCodec, lambda x: x)):
        lower, upper = codec(data[:40]).bounds(codec.code(data))
        score = exact(data[:40]).astype(np.longdouble) @ exact(data).astype(np.longdouble).T
        assert (lower <= score).all() and (score <= upper).all()
    assert len(exact_topk.Cells.code(data)) == 8 + 200 * 18


def test_classifiers_on_held_out_rows(spark, odd, empty):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op5_quality_classifier"].run(spark, folder).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.9
    langs = {r.doc_id: r.lang for r in common.documents(spark, folder).collect()}
    rows = [r for r in QUERIES["op4_language_id"].run(spark, folder).collect() if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) > 0.95
    got = {r.doc_id: r for r in language_id.language_answers(odd).collect()}
    assert all(got[i].lang_pred == "und" for i in (1, 2, 3, 8)) and got[5].lang_pred != "und"
    assert language_id.language_answers(empty).count() == 0
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    assert quality.quality_scores(odd, labels).count() == 11 and quality.quality_scores(empty, labels).count() == 0


def test_quality_is_learned_in_a_task(spark, monkeypatch):
    """Bags of texts stay away from the driver, which gets one number per bucket."""
    import os

    def elsewhere(*args, driver=os.getpid(), train=quality.train):
        assert os.getpid() != driver, "the driver trains"
        return train(*args)

    rows = [(i, f"{'good fine' if i % 2 else 'bad poor'} text {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    sample = quality.labelled_sample(docs, labels).orderBy("doc_id").collect()
    plain = quality.train([quality.bag(r.text) for r in sample], [r.quality for r in sample])
    monkeypatch.setattr(quality, "train", elsewhere)
    model = quality.fit(docs, labels)
    assert model.weights.any() and (model.weights == plain.weights).all() and model.bias == plain.bias


def test_bags_wait_packed(spark, monkeypatch):
    """Bags take at most half of eight bytes a bucket, and unpack to what they were."""
    import pyarrow as pa

    texts = ["", "one", "a b " * 400, " ".join(f"word{i}" for i in range(3_000))]
    found = [quality.bag(text) for text in texts]
    assert max(found[2][1]) > 255 and max(found[3][0]) >= 1 << 16 > min(found[3][0])
    columns = zip(*map(quality.packed, found))
    kinds = (pa.binary(), pa.int32(), pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["buckets", "low", "counts"])
    bags = quality.PackedBags()
    bags.add(batch)
    assert len(bags) == len(texts)
    for got, want in zip(bags, found):
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and len(got[0]) == len(want[0])
    assert [sum(len(x) for x in quality.packed(f)[::2]) / len(f[0]) for f in found[1:]] == [3, 4, 4]
    monkeypatch.setattr(quality, "SLICE_BYTES", 100)
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} text {i}") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    sample = quality.labelled_sample(docs, labels).orderBy("doc_id").collect()
    plain = quality.train([quality.bag(r.text) for r in sample], [r.quality for r in sample])
    assert np.allclose(quality.fit(docs, labels).weights, plain.weights, rtol=0, atol=1e-5)


def test_pipeline(spark):
    table = common.documents(spark, FOLDER)
    before = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.staged(stage(spark, before, FOLDER), "test-stage")
        assert after.columns == table.columns and after.count() > 0, name
        before = after
    assert corpus_pipeline.run(spark, FOLDER).count() >= before.count()


def test_a_full_memo_keeps_what_the_batch_holds(monkeypatch):
    """Chunks of a batch that are known when the memo is full are not learned a second time."""
    import pyarrow as pa

    tool = encode.ChunkEncoder(common.tokenizer_path("byte_bpe_50k.json"), True, memo_entries=6)
    learned, learn = [], tool._learn
    monkeypatch.setattr(tool, "_learn", lambda chunks: (learned.extend(chunks), learn(chunks)))
    for text in ("a b1 c2 d3", "b1 c2 e4 f5 g6", "b1 h7"):
        ids, _ = tool.encode(pa.array([text]))
        assert ids.tolist() == tool.tokenizer.encode(text, add_special_tokens=False).ids
    assert learned.count("b1") == 1 and learned.count("c2") == 1
