"""Operators on texts against plain Python, on the small table and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewise.llm import exact_dedup, jaccard_join, languages, mixing, packing, quality, substrings, token_files
from tablewise.llm.arrays import pieces
from tablewise.llm.queries import tokenizer_path
from tablewise.llm.shared import shared_path
from tablewise.llm.tokens import Encoder
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def low(x):
    return float("-inf") if x is None else x


def test_substrings(spark, documents, odd, empty):
    for docs, length in ((documents, 20), (odd, 3)):
        seen, want = {}, {}
        rows = sorted(set(plain(docs)), key=lambda r: low(r[0]))
        for number, text in rows:
            w, gone = words(text), set()
            for i in range(len(w) - length + 1):
                if tuple(w[i : i + length]) in seen:
                    gone.update(range(i, i + length))
                seen.setdefault(tuple(w[i : i + length]), number)
            want[number] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
        got = substrings.without_repeats(docs, length).collect()
        assert len(got) == docs.count()
        for r in got:
            assert (r.n_words, sum(s.end - s.start for s in r.spans), r.kept) == want[r.doc_id], r.doc_id
            assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    assert substrings.without_repeats(empty).count() == 0


@pytest.mark.parametrize("parts", [2, 8, 50])
@pytest.mark.parametrize("piece", [300, 1 << 22])
def test_substrings_meet_across_partitions(spark, documents, monkeypatch, parts, piece):
    want = {tuple(r) for r in substrings.without_repeats(documents.coalesce(1), 20).select("doc_id", "n_words", "kept").collect()}
    monkeypatch.setattr(substrings, "PIECE_BYTES", piece)
    assert {tuple(r) for r in substrings.without_repeats(documents.repartition(parts), 20).select("doc_id", "n_words", "kept").collect()} == want


def test_substrings_split_prefixes(documents, monkeypatch):
    want = {tuple(r) for r in substrings.without_repeats(documents, 5).select("doc_id", "n_words", "kept").collect()}
    monkeypatch.setattr(substrings, "GROUP", 3000)
    assert {tuple(r) for r in substrings.without_repeats(documents, 5).select("doc_id", "n_words", "kept").collect()} == want


def test_frequent_prefixes_get_longer():
    counts = np.array([[90, 10], [60, 40], [50, 50]])
    longer, task = substrings.dealt(counts, 5)
    assert longer.tolist() == [[True, True], [True, True], [False, False]] and len(set(task[2])) == 2


@pytest.mark.parametrize(("size", "num", "den"), [(3, 90, 100), (5, 4, 5)])
def test_jaccard(documents, odd, empty, size, num, den, monkeypatch):
    for docs, block in ((documents, 1000), (documents, 3), (odd, 1000)):
        monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
        monkeypatch.setattr(jaccard_join, "BLOCK_COUNTS", block)
        sets = {}
        for number, text in plain(docs):
            w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
            sets[number] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
        root = {d: d for d in sets}
        for a in sorted(sets, key=low):
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and den * both >= num * len(sets[a] | sets[b]):
                    x, y = root[a], root[b]
                    least = min(x, y, key=low)
                    root = {d: least if r in (x, y) else r for d, r in root.items()}
        got = jaccard_join.similar(docs, size, num, den).collect()
        assert len(got) == docs.count()
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(d, len(sets[d]), root[d]) for d in sets}
    assert jaccard_join.similar(empty).count() == 0


def test_every_similar_pair_shares_a_key():
    rng = np.random.default_rng(5)
    for num, den in ((90, 100), (4, 5)):
        for n in (3, 7, 10, 14, 30, 80, 400):
            for _ in range(20):
                base = rng.integers(0, 2**63, n, dtype=np.uint64)
                cut = int(rng.integers(0, n // 4 + 1))
                other = np.concatenate([base[cut:], rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)])
                common = n - cut
                if den * common < num * (n + len(other) - common) or len(other) == common == n:
                    continue
                a, b = np.unique(base), np.unique(other)
                key, of = jaccard_join.keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), num, den)
                assert set(key[of == 0]) & set(key[of == 1]), (num, den, n, cut)


def test_every_similar_pair_shares_a_key_beside_common_grams():
    """Whatever n-grams count as frequent: none, a few, most or all of a set's."""
    rng = np.random.default_rng(6)
    for num, den in ((90, 100), (4, 5)):
        for n in (7, 14, 30, 80, 400):
            for share in (0, 0.1, 0.3, 0.5, 0.7, 1):
                for _ in range(10):
                    base = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
                    cut = int(rng.integers(0, n // 4 + 1))
                    other = np.concatenate([base[cut:], rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64) * np.uint64(2)])
                    if den * (n - cut) < num * (cut + len(other)) or len(other) == n - cut == n:
                        continue
                    a, b = np.unique(base), np.unique(other)
                    both = np.union1d(a, b)
                    common = np.sort(np.concatenate([both[rng.random(len(both)) < share], rng.integers(0, 2**63, 50, dtype=np.uint64)]))
                    key, of = jaccard_join.keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), num, den, common)
                    assert set(key[of == 0]) & set(key[of == 1]), (num, den, n, cut, share)


def test_a_shared_passage_makes_no_candidates(spark, monkeypatch):
    """Texts that have one passage in common are unlike: before, each of their pairs was a candidate, and the number of these grew with the square of the corpus."""
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    passage, seen = word(30), {}
    texts_ = [f"{word(100)} {passage} {word(100)}" for _ in range(200)]
    near = [t.rsplit(" ", 1)[0] for t in texts_[:20]]  # near copies stay candidates, and are found
    rows = list(enumerate(texts_ + near))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wrapped = jaccard_join.candidates
    monkeypatch.setattr(jaccard_join, "candidates", lambda *a: seen.setdefault("edges", wrapped(*a)))
    for paired in (32, 3):
        seen.clear()
        monkeypatch.setattr(jaccard_join, "PAIRED", paired)
        monkeypatch.setattr(jaccard_join, "COMMON_TEXTS", 100)
        monkeypatch.setattr(jaccard_join, "COMMON_SHARE", 1)
        got = {r.doc_id: r.component_id for r in jaccard_join.similar(docs).collect()}
        assert got == {i: i % 200 for i, _ in rows}
        assert 20 <= seen["edges"].count() < 100


def test_counts_by_fragment_bound_the_overlap():
    rng = np.random.default_rng(11)
    pool = rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(rng.choice(pool[: int(rng.integers(1, 5000))], int(rng.integers(1, 3000)))) for _ in range(40)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    sets.append(np.sort(rng.integers(0, 2**63, 300_000, dtype=np.uint64) >> np.uint64(7)))  # many in one fragment
    offsets = np.append(offsets, offsets[-1] + 300_000)
    counts = [jaccard_join._counts(x) for x in jaccard_join.histograms(np.concatenate(sets), offsets)]
    bound, common = jaccard_join.most_in_common(counts, counts), jaccard_join.overlaps([np.unique(x) for x in sets])
    assert (bound[:-1, :-1] >= common[:-1, :-1]).all() and (np.diag(bound) == offsets[1:] - offsets[:-1]).all() and (bound == bound.T).all()
    assert (bound == [[_least(a, b) for b in counts] for a in counts]).all()


def _least(a, b):
    few = min(len(a), len(b))
    return np.minimum(a.reshape(few, -1).sum(axis=1), b.reshape(few, -1).sum(axis=1)).sum()


@pytest.mark.parametrize(("num", "den"), [(90, 100), (4, 5), (3, 4)])
def test_sets_of_every_size_end_with_few_empty_parts(num, den):
    """The smallest set that uses a cut, one of the class before, has no more empty parts than allowed in most orders."""
    first, fragments, spare = jaccard_join.cuts(num, den)
    on = fragments > 0
    first, fragments, spare = first[on], fragments[on], spare[on]
    least = -(-first * num // den)
    assert (fragments - np.minimum(fragments, least) <= spare).all()
    assert (fragments * np.exp(-least / fragments) <= spare).all()
    size = least[np.searchsorted(first, 20_000)]
    key, _ = jaccard_join.keys(np.sort(np.random.default_rng(1).integers(0, 2**64, size, dtype=np.uint64)), np.array([0, size]), num, den)
    assert len(key) < 10 * size


def test_exact_dedup_odd_rows(odd, empty):
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == len(ODD)
    groups = defaultdict(list)
    for number, text, *_ in ODD:
        groups["".join(words(text))].append((number, text or ""))
    for r in got:
        key = next(k for k, rows in groups.items() if hashlib.sha256(k.encode()).digest() == bytes(r.digest))
        best = min(groups[key], key=lambda x: (-len(x[1]), low(x[0])))
        assert (r.keep_id, r.group_size) == (best[0], len(groups[key]))
    assert sorted(r.doc_id or 0 for r in exact_dedup.without_copies(odd).collect()) == [0, 2, 2, 5, 6, 7, 8, 9]
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_in_rounds(documents, monkeypatch):
    want = {tuple(r) for r in exact_dedup.exact_groups(documents).select("doc_id", "keep_id", "group_size").collect()}
    assert {tuple(r) for r in exact_dedup.exact_groups(documents, radix=2).select("doc_id", "keep_id", "group_size").collect()} == want


def test_mixing_odd_rows(odd, empty):
    got = mixing.copies(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.copies <= 2 for r in got)
    assert mixing.copies(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert {tuple(r) for r in got} == {tuple(r) for r in mixing.copies(odd).collect()}
    assert mixing.mixed(odd).columns == odd.columns


def test_mixed_gives_every_row_its_own_copies(spark):
    rows = [(None, f"word {i} " * (1 + i % 5), "a", "x") for i in range(300)] + [(7, f"other {i}", "b", "x") for i in range(40)]
    rows += [(None, "the same row", "a", "x")] * 2_500 + [(i, "a text of its own", "c", None) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string").repartition(5)
    taken = mixing.copies(docs)
    assert taken.where("copies < 0 or copies > 3").count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    sizes = docs.select("source", F.size(F.split(F.trim("text"), " ")).alias("size"))
    words = {r.source: (r.s, r.n) for r in sizes.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    goal = {r.source: r.target for r in docs.select("source").distinct().crossJoin(taken.select("source_size", "target").distinct()).where("1 = 1").collect() if r.source_size == words[r.source][0]}
    for source, (size, n) in words.items():
        assert abs(got[source] - n * goal[source] / size) <= 1
    alike = out.where("text = 'the same row'").count()
    assert abs(alike - 2_500 * goal["a"] / words["a"][0]) <= 1
    most = out.where("source = 'b'").groupBy("text").count().agg(F.max("count"), F.min("count")).first()
    assert most[0] - most[1] <= 1 and sorted(map(str, out.collect())) == sorted(map(str, mixing.mixed(docs.repartition(2)).collect()))


def test_rows_without_a_number_are_held_out(spark):
    got = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long").select(languages.held_out(F.col("doc_id")).alias("h")).collect()
    assert got[0].h is True and all(isinstance(r.h, bool) for r in got)


def test_mixing_is_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken, target, size = Counter(), {}, Counter()
    of = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for r in mixing.copies(docs).collect():
        taken[of[r.doc_id]] += r.copies * r.size
        size[of[r.doc_id]] = max(size[of[r.doc_id]], r.size)
        target[of[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= max(0.05 * target[s], size[s]) for s in target)


@pytest.fixture(scope="module")
def library():
    return Encoder(tokenizer_path()).library


def encode(library, texts):
    return [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_tokens_equal_the_library(documents, library):
    own, rng = Encoder(tokenizer_path(), most=500), random.Random(3)
    letters = " \n\t\r'  　sStreldvm'a1!é中́²½१_-.  '’😀​\x85\x1c"
    given = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [None, "", "don't we'll", "\n's", "<|endoftext|>"]
    given += [t for _, t in plain(documents)]
    got = []
    for _, data, offsets in pieces(pa.array(given, pa.string())):
        ids, begin = own.ids(data, offsets)
        got += [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)]
    assert got == encode(library, given)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(documents, odd, empty, library):
    for docs in (documents, odd):
        rows = plain(docs)
        ids = {n: x + [2] for (n, _), x in zip(rows, encode(library, [t for _, t in rows]), strict=True)}
        repeats = Counter(n for n, _ in rows)
        got, by, bins = packing.packed(docs, tokenizer_path()).collect(), defaultdict(list), defaultdict(list)
        for r in got:
            by[r.doc_id].append(r)
            bins[r.sequence_id].append(r)
        for n, x in ids.items():
            own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by[n]})
            assert sum(r[2] for r in own) == len(x) and len(by[n]) == repeats[n] * len(own)
            assert own == [(k, s, size, crc(x[s : s + size])) for k, s, size, _ in own]
            assert all(size == 1024 for k, _, size, _ in own if k)
        for rows in bins.values():
            rows.sort(key=lambda r: r.offset)
            ends = np.cumsum([r.length for r in rows])
            assert [r.offset for r in rows] == [0, *ends[:-1]] and ends[-1] <= 1024
        total = sum(len(ids[n]) * k for n, k in repeats.items())
        assert len(bins) <= total / 1024 * 1.03 + 3
    assert packing.packed(empty, tokenizer_path()).count() == 0


def test_two_that_fit_better_replace_the_smallest():
    found = packing.fillings({6: 1, 3: 1, 2: 2}, 10)
    assert found[0] == ([6, 2, 2], 1) and sum(n * sum(x) for x, n in found) == 13


def test_fillings_use_every_piece_once():
    rng = np.random.default_rng(2)
    counts = dict(Counter(rng.integers(1, 1025, 5000).tolist()))
    used = Counter()
    for inside, n in packing.fillings(counts, 1024):
        assert sum(inside) <= 1024
        for length in inside:
            used[length] += n
    assert used == counts


def test_token_files(spark, documents, odd, empty, library):
    for docs in (documents, odd):
        path = shared_path(spark, "test-files")
        token_files.write_ids(docs, path, tokenizer_path())
        rows = sorted(plain(docs), key=lambda r: (low(r[0]), r[1] or ""))
        at, want = 0, []
        for (n, _), x in zip(rows, encode(library, [t for _, t in rows]), strict=True):
            want.append((n, at, len(x) + 1, crc(x + [0])))
            at += len(x) + 1
        got = sorted((tuple(r) for r in token_files.read_ids(spark, path).collect()), key=lambda r: r[1])
        assert got == want
    path = shared_path(spark, "test-files")
    token_files.write_ids(empty, path, tokenizer_path())
    assert token_files.read_ids(spark, path).count() == 0


def test_word_aligned_blocks():
    rng = np.random.default_rng(1)
    for case in range(60):
        n = int(rng.integers(0, 5000))
        bits = rng.integers(0, 65 if case % 2 else 17, n)
        x = np.array([int(rng.integers(0, 2**63, dtype=np.uint64) * 2 + 1) >> (64 - int(b)) if b else 0 for b in bits], np.uint64)
        image = token_files.to_image(np.arange(3), np.array([0, n, 0]), x)
        assert (token_files.from_image(image)[2] == x).all()
        for k in range(-(-n // token_files.BLOCK)):
            assert (token_files.block_ids(image, k) == x[k * token_files.BLOCK : (k + 1) * token_files.BLOCK]).all()


def test_languages(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = languages.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    rows = languages.identified(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.lang_pred for r in rows}
    assert {by[n] for n in (3, 4, 5, 6)} == {"und"} and by[7] == "de"
    assert languages.with_language(odd).count() == 7 and languages.with_language(odd).columns == odd.columns
    assert languages.identified(empty).count() == 0


def test_unknown_words_fall_back_to_shorter_grams():
    known = [{}, {}, {"^a": 0}, {"abc": 1}, {}, {}]
    model = languages.Model(["p", "q"], np.zeros(2), known, np.array([[0.0, 1.0], [2.0, 0.0]], np.float32))
    assert model.row("abcd").tolist() == [2, 0] and model.row("ax").tolist() == [0, 1] and model.row("zz").tolist() == [0, 0]


def test_quality(spark, odd, empty):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.9
    known = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (7, None, 1), (None, 1, 0), (9, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality.scored(odd, known).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.score for r in quality.scored(odd, known.where("false")).collect()} == {0.5}
    assert quality.scored(empty, known).count() == 0


def test_pooling_is_monotone():
    rng = np.random.default_rng(4)
    n = rng.integers(1, 9, 200).astype(float)
    at, value = quality.pooled(n, rng.binomial(n.astype(int), np.linspace(0.1, 0.9, 200)).astype(float), np.arange(200.0))
    assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all()


def test_unlike_texts_of_one_number_are_documents_of_their_own(spark):
    passage = [f"p{i}" for i in range(30)]
    long, short, other = ["a"] + [f"a{i}" for i in range(50)] + passage, ["b", *passage], [f"c{i}" for i in range(40)]
    for first in (None, 5):
        rows = [(first, " ".join(long)), (first, " ".join(short)), (first, " ".join(other)), (9, " ".join([f"d{i}" for i in range(60)])), (10, " ".join(["e", *passage, "f"]))]
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        got = [(r.doc_id, r.kept.split()) for r in substrings.without_repeats(df, 20).collect()]
        whole = {x[0]: x for x in (long, short, other)}
        assert sorted(d or 0 for d, _ in got) == [first or 0] * 3 + [9, 10]
        kept = {w[0]: w for d, w in got if d == first}
        assert set(kept) == set(whole) and kept["c0"] == other
        assert sorted(len(whole[k]) - len(kept[k]) for k in "ab") == [0, 30]
        assert all(kept[k] in (whole[k], whole[k][:-30]) for k in "ab")
        assert {d: w for d, w in got if d in (9, 10)} == {9: rows[3][1].split(), 10: ["e", "f"]}


def test_words_that_cancel_in_polynomials_stay_apart(spark):
    """A word of the letters a and b by the parity of the bits of their place, and its complement."""
    rows, twins = [], []
    for k in (10, 11, 12):
        word = "".join("ab"[i.bit_count() % 2] for i in range(1 << k))
        twins.append((word, word.translate({97: 98, 98: 97})))
    rows = [(i, " ".join(f"{t[i]}{n}" if n % 2 else t[i] for n in range(8) for t in twins)) for i in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.doc_id, r.component_id) for r in jaccard_join.similar(docs, 3, 90, 100).orderBy("doc_id").collect()] == [(0, 0), (1, 1)]
    one = [(0, " ".join(["w"] * 19 + [twins[1][0]])), (1, " ".join(["w"] * 19 + [twins[1][1]]))]
    got = substrings.without_repeats(spark.createDataFrame(one, "doc_id long, text string"), 20).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [t for _, t in one]
    library = Tokenizer.from_file(tokenizer_path())
    mine = Encoder(tokenizer_path())
    for texts_ in (twins, [tuple(t for _, t in rows)]):
        for pair in texts_:
            data = np.frombuffer("".join(pair).encode(), np.uint8)
            ids, at = mine.ids(data, np.array([0, len(pair[0]), len(pair[0]) + len(pair[1])]))
            assert [ids[at[i] : at[i + 1]].tolist() for i in (0, 1)] == [library.encode(t, add_special_tokens=False).ids for t in pair]


def test_jaccard_compares_each_text_of_one_number(spark):
    base = [f"w{i}" for i in range(100)]
    for first in (None, 5):
        rows = [(first, "nothing like the others at all"), (first, " ".join(base)), (7, " ".join([*base, "x"])), (8, " ".join(f"v{i}" for i in range(50))), (first, " ".join([*(f"v{i}" for i in range(50)), "y"]))]
        got = jaccard_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
        assert len(got) == 5 and all(r.component_id == first for r in got)


def test_added_tokens_are_those_of_the_library():
    from tokenizers import Tokenizer

    fresh, own, rng = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path()), random.Random(4)
    parts = ["<|endoftext|>", "<|endof", "text|>", "<|", "|>", "a", " b", "  ", "\n", "'s", "1", "é"]
    given = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(2000)] + ["a <|endoftext|> b", "<|endof", "text|>", None, "<|endoftext|><|endoftext|>"]
    got = []
    for _, data, offsets in pieces(pa.array(given, pa.string())):
        ids, begin = own.ids(data, offsets)
        got += [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)]
    assert got == encode(fresh, given) and got[2000] == [64, 220, 50256, 275]


def test_language_stage_writes_what_it_finds(spark, documents):
    known = documents.where("lang IS NOT NULL")
    got = languages.with_language(known.withColumn("lang", languages.F.when(~languages.held_out(languages.F.col("doc_id")), languages.F.col("lang"))))
    found = {r.doc_id: r.lang for r in got.collect()}
    true = {r.doc_id: r.lang for r in known.collect() if r.doc_id in found}
    assert all(found.values()) and sum(found[d] == x for d, x in true.items()) > 0.95 * len(true)
    rows = [(1, "letters", None), (2, "123", None), (3, None, None), (4, "", None)]
    got = languages.with_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert [tuple(r) for r in got] == [(1, "letters", None)]
