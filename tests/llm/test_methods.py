"""The methods against brute force, round trips and held-out rows."""

import collections
import gzip
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import oracle_check
import pytest

from offerlens.llm import main_text, near_dedup, pu_quality, quality_rules, queries, samples, segmentations, setsketch, token_counts, toxicity, warc, words

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_oracle(spark, monkeypatch, name):
    monkeypatch.setattr(oracle_check, "registry", queries)
    status, _, _, note = oracle_check.compare(spark, oracle_check.connect(SMALL), SMALL, name)
    assert status == "ok", note


def test_word_hashes_are_one_to_one(texts):
    encoded = words.encoded(texts + ["", None, "x" * (3 * words.PIECE), "a b " * words.PIECE], words.SPACED)
    hashed, seen = words.hash_words(encoded), {}
    for i, data in enumerate(encoded):
        own = data.split()
        assert len(own) == hashed.counts()[i]
        for word, value in zip(own, hashed.of(i).tolist()):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def _plain_rules(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = collections.Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    repeated = {j for i in range(len(own) - 4) if at[tuple(own[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_rule_counts(texts):
    odd = ["", "a a a a a a a", "x\n\n x\n x\nx", "é ü z #*$%&|<> " * 3, "\x1f a\x85b \x0b c"]
    found = quality_rules.measured.func(__import__("pandas").Series(texts + odd))
    for text, row in zip(texts + odd, found.itertuples()):
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == _plain_rules(text)
        assert row.base_failed == (row.n_words < 10 or 100 * row.n_repeat_words > 20 * row.n_words)


def test_compression_bands():
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(2000))
    noise = "".join(chr(rng.randint(33, 126)) for _ in range(9000))
    pad = " ".join(f"{prose[i:i + 40]}" for i in range(0, 400, 40))
    found = quality_rules.measured.func(__import__("pandas").Series([prose, noise[:300] + " " + " ".join(noise[i : i + 7] for i in range(0, 9000, 7)), (pad + " 1 ") * 50]))
    assert found["ratio"].between(0, 1).all() and list(found["kept"]) == [True, False, False]


def test_token_counts_are_the_librarys(texts):
    from tokenizers import Tokenizer

    library, counter = Tokenizer.from_file(token_counts.vocabulary_path()), token_counts.Counter(token_counts.vocabulary_path())
    rng = random.Random(2)
    alphabet = [*"aAbé.!'sT 9½Σσς́İ\t\n\x1c\x85漢🙂한ﬁǅ̣ÅK", "<|startoftext|>", "<|endoftext|>", "'ll"]
    mixed = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    singles = [f"a{c}b1{c}{c}!{c}'ll{c}'s" for c in map(chr, range(0x300))]
    every = texts + mixed + singles + ["x" * 5000, "!" * 5000]
    assert counter.counts(every) == [len(e.ids) for e in library.encode_batch(every, add_special_tokens=False)]
    assert len(counter.whole) > 30_000


def test_sketches_estimate_and_merge():
    values, errors = words.stream(3, 3000), []
    for share in (0.3, 0.6, 0.75, 0.9):
        a, b = values[:1000], np.concatenate([values[: int(2000 * share / (1 + share))], values[1500 : 2500 - int(2000 * share / (1 + share))]])
        both = len(np.intersect1d(a, b))
        x, y = setsketch.registers(a), setsketch.registers(b)
        found = setsketch.estimate(x[None], y[None], np.array([len(a)]), np.array([len(b)]))[0]
        errors.append(abs(found - both / (len(a) + len(b) - both)))
        assert (np.maximum(x, y) == setsketch.registers(np.union1d(a, b))).all()
    assert max(errors) < 0.12


def test_near_copies_of_a_chain(spark):
    """A chain whose ends share little, copies, a large group around one text, and texts that only share a passage."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(200)], []
    chain = list(base)
    for i in range(12):
        rows.append((100 + i, " ".join(chain)))
        chain = chain[8:] + [word() for _ in range(8)]
    rows += [(500 + i, " ".join(base[:90] + [word() for _ in range(110)])) for i in range(40)]
    for i in range(60):
        own = list(base)
        for _ in range(i % 9):
            own[rng.randrange(200)] = word()
        rows.append((700 + i, " ".join(own)))
    rows += [(5, rows[3][1].upper()), (900, "lone text"), (901, "lone text"), (902, "Lone text!")]
    sets = {i: set(near_dedup.shingle_sets([t])[0].tolist()) for i, t in rows}
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == least


def test_held_out_accuracy(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    for run, place, least in ((toxicity.toxicity, 1, 0.9), (pu_quality.quality_scores, 0, 0.97)):
        rows = [(r.score, known[r.doc_id][place]) for r in run(documents, labels).where("held_out").collect() if r.doc_id in known]
        ones, zeros = ([s for s, y in rows if y == v] for v in (1, 0))
        auc = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
        assert auc > least, (place, auc)


def test_held_out_rows(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(40), None]], "doc_id long").select("doc_id", samples.held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    documents, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    for run in (toxicity.toxicity, pu_quality.quality_scores):
        assert sorted(map(tuple, run(documents, labels).collect())) == sorted(map(tuple, run(documents, flipped).collect()))


def test_segmentations_follow_their_probabilities():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=segmentations.model_path())
    size, sampler = model.get_piece_size(), segmentations.Sampler(segmentations.model_path())
    weight = {model.id_to_piece(i): (i, -math.log((-model.get_score(i) if 0 <= -model.get_score(i) < size else size) + 2)) for i in range(259, size)}

    def ways(text, at=0, ids=(), total=0.0):
        if at == len(text):
            yield ids, total
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in weight:
                i, w = weight[text[at:end]]
                yield from ways(text, end, (*ids, i), total + w)

    every = dict(ways("▁teeth▁in"))
    scale = math.log(sum(map(math.exp, every.values())))
    chances = {k: math.exp(w - scale) for k, w in every.items()}
    n, first, drawn = 6000, collections.Counter(), collections.Counter()
    for rows in sampler.sample(["teeth in"] * n, list(range(n)), 3):
        own = [tuple(r[0].tolist()) for r in rows]
        assert len(set(own)) == 3 and all(abs(r[1] - math.log(chances[k])) < 1e-9 for r, k in zip(rows, own))
        first[own[0]] += 1
        for r, k in zip(rows, own):
            drawn[k] += 1 / r[2]  # inclusion scores make every segmentation count once on average
    for k, p in sorted(chances.items(), key=lambda x: -x[1])[:4]:
        assert abs(first[k] / n - p) < 0.03
        if p > 0.02:
            assert abs(drawn[k] / n - 1) < 0.1


def test_segmentations_decode(texts):
    sampler = segmentations.Sampler(segmentations.model_path())
    odd = ["  two  spaces ", "\n\n", "🙂é漢\x00", "a" * 3000, " "]
    for text, rows in zip(texts + odd, sampler.sample(texts + odd, list(range(len(texts + odd))), 2)):
        assert all(sampler.vocabulary.decode(r[0].tolist()) == text for r in rows)
    again = [sampler.sample([t], [i], 2) for i, t in enumerate(texts[:20])]
    whole = sampler.sample(texts[:20], list(range(20)), 2)
    assert [[tuple(r[0]) for r in rows[0]] for rows in again] == [[tuple(r[0]) for r in rows] for rows in whole]


class _File:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_every_split_of_an_archive_gives_each_record_once():
    rng, members, starts = random.Random(5), [], []
    for i in range(60):
        body = bytes(rng.randrange(256) for _ in range(rng.randrange(0, 4000))) + warc.MAGIC * 3 + gzip.compress(b"no record")
        starts.append(sum(map(len, members)))
        members.append(gzip.compress(warc.record(f"urn:page:{i}", None, body, hashlib.sha1(body).hexdigest(), None), mtime=0))
    data = b"".join(members)
    for size in (1, 97, 4096, len(data)):
        found = [at for s in range(0, len(data), size) for at, _ in warc.records_between(_File(data), len(data), s, min(s + size, len(data)))]
        assert found == starts


def test_main_text_of_pages_without_an_article():
    page = """<html><body><header><h1>Site</h1></header><div id=sidebar><p>beside</div><div class="post"><h2>Title &amp; co</h2>
    <p>First one with <a href=q>a link</a> and a lot of words in it, more than anything around it has.<p>Second<br>one
    that is long enough too.<div><p>Third &lt;b&gt;</p></div></div><div class="comments"><p>nice post, thanks a lot!</p></div><form><p>send</form>
    <div class="cookie-notice"><p>We use cookies on this site and this text is long as well.</div><footer>foot</footer>"""
    assert main_text.main_text(page).split("\n\n") == [
        "Title & co", "First one with a link and a lot of words in it, more than anything around it has.", "Second one that is long enough too.", "Third <b>"
    ]
    inside = """<body class="has-sidebar no-comments"><div class="main-menu"><p>menu words here</div><div id="content"><div class="entry-header"><h1>Head</h1></div>
    <p>The text of the article has a sentence.<p>And another sentence that is as long.</div><div class="post-comments"><p>I read this and have much to say about it all.</div>
    <section id=comments-list><p>More words by readers of this page.</section><div class="site-footer">foot</div><div class=sidebar-left>left</div>"""
    assert main_text.main_text(inside).split("\n\n") == ["Head", "The text of the article has a sentence.", "And another sentence that is as long."]
    parts = "<body><div><h1>Top</h1>" + "".join(f"<section><h2>H{i}</h2>" + f"<p>{'A long sentence about it. ' * (6 + i)}</p>" * 4 + "</section>" for i in range(3)) + "</div>"
    assert [b[:3] for b in main_text.main_text(parts).split("\n\n")] == ["Top"] + ["H0", "A l", "A l", "A l", "A l", "H1", "A l", "A l", "A l", "A l", "H2", "A l", "A l", "A l", "A l"]
    assert [main_text.main_text(x) for x in (None, "", "<p>only", "a &eacute;", "<script>x</script>", "<")] == ["", "", "only", "a é", "", "<"]


def test_pu_share_is_estimated():
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(30, 90)))
    bad = lambda: " ".join([f"{good()[:5]}!!".upper()] * 40)
    model = pu_quality.train([good() for _ in range(2000)], [good() if rng.random() < 0.7 else bad() for _ in range(3000)])
    assert abs(model.share - 0.7) < 0.08
    assert model.scores([good()])[0] > 0.7 > model.scores([bad()])[0]


def test_lattices_look_up_beginnings_of_pieces_only(monkeypatch):
    vocabulary, looked = segmentations.Vocabulary(segmentations.model_path()), []
    distinct = [segmentations.SPACE + "q7" * 400, segmentations.SPACE + "nation", "zxqj", "é\U0001f600"]
    find = vocabulary.find
    monkeypatch.setattr(vocabulary, "find", lambda hashed: looked.append(len(hashed)) or find(hashed))
    with np.errstate(over="ignore"):
        lattices = segmentations.Lattices(vocabulary, distinct)
        one = segmentations._uniform(np.array([2**63 + 5], np.uint64), np.array([77]), 912)[0]
    ids = {vocabulary.raw[i].decode().replace(" ", segmentations.SPACE): int(i) for i in vocabulary.ids}
    for word, place in zip(distinct, lattices.first):
        found = {lattices.piece[e] for e in range(lattices.begin[place], lattices.begin[place + 1])}
        expected = {ids[word[:n]] for n in range(1, len(word) + 1) if word[:n] in ids}
        assert found - {vocabulary.size + ord(word[0])} == expected
    assert sum(looked) < 6 * sum(map(len, distinct))  # of up to `longest` lengths at each place
    assert segmentations._uniform_one(2**63 + 5, 77, 912) == one


def test_training_features_lie_in_a_few_arrays():
    texts = ["a bad wörd", "", "fine", *[f"text {i} of many" for i in range(600)]]
    packed = toxicity._packed(texts)
    assert len({id(ids.base) for ids, _ in packed}) == 3 and len(packed) == len(texts)
    for text, found in zip(texts, packed):
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(found, toxicity.features(text)))
    assert toxicity._packed([]) == []


def test_toxicity_is_trained_in_a_task(spark, monkeypatch):
    rows = [(i, f"{'bad wörd' if i % 3 == 0 else 'good one'} of text {i}", int(i % 3 == 0)) for i in range(90)]
    documents = spark.createDataFrame([r[:2] for r in rows] + [(None, "no id"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1)], "doc_id long, toxic int")
    found = toxicity.fitted(documents, labels)
    assert len(found.weights) == 1 << toxicity.BITS and found.scores(["bad wörd"])[0] > found.scores(["good one"])[0]
    few = documents.where("doc_id is not null and text is not null")
    found, expected = toxicity.fitted(few, labels), toxicity.train(*samples.labelled(few, labels, "toxic"))
    assert found.weights.tobytes() == expected.weights.tobytes() and found.bias == expected.bias
    assert toxicity.fitted(few, labels.where("false")).bias == 0.0
    assert toxicity.fitted(few, labels.where("toxic = 1")).bias > 0
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, share: toxicity.Model(np.zeros(1, np.float32), float(os.getpid())))
    assert toxicity.fitted(few, labels).bias not in (0.0, os.getpid())  # the driver's process holds neither texts nor features


def test_lattices_are_built_in_parts(monkeypatch):
    vocabulary = segmentations.Vocabulary(segmentations.model_path())
    texts = ["the nation of words", "", "two  spaces  and ▁ more", "the\nlines\n\n of\x00zeros the", "é\U0001f600 words"]
    distinct, number, counts = vocabulary.words(texts)
    parts, at = distinct.to_pylist(), 0
    assert len(set(parts)) == len(parts)
    for text, n in zip(texts, counts):
        marked = segmentations.SPACE + text.replace(" ", segmentations.SPACE) if text else ""
        assert [parts[i] for i in number[at : at + n]] == re.findall("▁+[^▁\n]*|[^▁\n]+|\n", marked)
        at += n
    with np.errstate(over="ignore"):
        whole = segmentations.Lattices(vocabulary, parts)
        monkeypatch.setattr(segmentations, "PART", 7)
        cut = segmentations.Lattices(vocabulary, distinct)
    for a, b in zip(whole.first, cut.first):  # each word's lattice is the same, wherever its places lie
        n = len(parts[list(whole.first).index(a)])
        for lattice, place in ((whole, a), (cut, b)):
            assert lattice.after[place] == 0 and lattice.begin[place + 1] > lattice.begin[place]
        stack = [(a, b)]
        while stack:
            p, q = stack.pop()
            e, f = (slice(x.begin[y], x.begin[y + 1]) for x, y in ((whole, p), (cut, q)))
            assert (whole.piece[e] == cut.piece[f]).all() and np.allclose(whole.log[e], cut.log[f]) and np.allclose(whole.upto[e], cut.upto[f])
            assert whole.after[p] == cut.after[q] < n
            stack += [(x, y) for x, y in zip(whole.next[e], cut.next[f]) if x >= 0 or y >= 0]


def test_words_of_several_batches_keep_their_lattices(monkeypatch):
    monkeypatch.setattr(segmentations, "CHOSEN_FROM", 2)
    monkeypatch.setattr(segmentations, "CHOSEN_EVERY", 5)
    sampler, built = segmentations.Sampler(segmentations.model_path()), []
    part = segmentations._part
    monkeypatch.setattr(segmentations, "_part", lambda v, codes, lengths: built.append(len(lengths)) or part(v, codes, lengths))
    for turn in range(9):
        texts = [f"the same words and {'new' * turn} {turn}", "", "the same", f"only{turn}"]
        del built[:]
        with np.errstate(over="ignore"):
            found = sampler.sample(texts, [5, 6, 7, 8], 2)
            new = sum(built)
            fresh = segmentations.Sampler(segmentations.model_path()).sample(texts, [5, 6, 7, 8], 2)
        assert [[(r[0].tolist(), r[1]) for r in rows] for rows in found] == [[(r[0].tolist(), r[1]) for r in rows] for rows in fresh]
        if turn in (2, 3, 4, 5, 7, 8):
            assert new < 5
