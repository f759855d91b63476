"""Probable duplicates and link groups against brute force on hot blocks."""

import collections
import datetime as dt
import random

from offerlens.operators import duplicates as Du
from offerlens.operators import links as L

SCHEMA = "offer_id string, title string, company_name string, commune_code string, contract_kind string, description_text string, source_published_at timestamp, words string, day string, class int"


def _groups(n, linked):
    least = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(least[a], least[b])
            changed |= (least[a], least[b]) != (low, low)
            least[a] = least[b] = low
    return least


def _plain(rows):
    """Rows are (offer_id, block, text, day)."""
    sets = [frozenset((text or "").split()) for _, _, text, _ in rows]
    classes = {(r[1], s) for r, s in zip(rows, sets)}
    df = collections.Counter(w for _, s in classes for w in s)
    weight = {w: (len(classes) // n).bit_length() for w, n in df.items()}
    total = lambda s: sum(weight[w] for w in s)
    day = [r[3] or dt.datetime(1970, 1, 1) for r in rows]
    linked = [
        (a, b) for a in range(len(rows)) for b in range(a) if rows[a][1] == rows[b][1] and abs((day[a] - day[b]).days) <= 30
        and (sets[a] == sets[b] or 4 * total(sets[a] & sets[b]) >= 3 * total(sets[a] | sets[b]))
    ]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    place = {i: k for k, i in enumerate(order)}
    least = _groups(len(rows), [(place[a], place[b]) for a, b in linked])
    sizes = collections.Counter(least)
    return sorted((rows[i][0], rows[order[least[place[i]]]][0], sizes[least[place[i]]]) for i in range(len(rows)) if sizes[least[place[i]]] > 1)


def _run(spark, rows):
    frame = spark.createDataFrame([(i, f"Job {b}!", b, "c", None, t, d, "x", "y", 1) for i, b, t, d in rows], SCHEMA)
    return sorted((r.offer_id, r.cluster_id, r.cluster_size) for r in Du.probable_duplicates(frame).collect())


def test_changed_words_and_dates(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []

    def add(block, words, day):
        rows.append((f"o{len(rows):05}", block, None if words is None else " ".join(words), day and dt.datetime(2024, 1, 1) + dt.timedelta(days=day)))

    for g in range(25):
        base = rng.sample(vocabulary, rng.randint(20, 80))
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for k in rng.sample(range(len(own)), rng.randint(0, len(own) // 9)):  # up to a sixth of the words changed
                own[k] = rng.choice(vocabulary)
            rng.shuffle(own)
            add(rng.choice(["a", "a", None]), own, rng.choice([None, *range(1, 200, 7)]))
    base = rng.sample(vocabulary, 60)
    for i in range(80):  # one hot block around one text, half of it in another version
        own = base[: 60 if i % 2 else 45] + [f"v{k}" for k in range(15 * (i % 2 == 0))]
        for k in rng.sample(range(len(own)), i % 9):
            own[k] = f"x{rng.randrange(400)}"
        add("hot", own, rng.randint(1, 300))
    for words in ([], None, [], ["one"], ["one"]):
        add("a", words, 5)
    rows += [rows[3], rows[3]]  # repeated rows
    want = _plain(rows)
    assert len(want) > 60 and _run(spark, rows) == want


def test_copies_with_a_tenth_of_the_words_changed_are_found(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(100)]
        copy = [rng.choice("pqrstuvw") if k % 10 == 4 else w for k, w in enumerate(words)]
        rows += [(f"a{i:03}", str(i % 3), " ".join(words), dt.datetime(2024, 1, 1)), (f"b{i:03}", str(i % 3), " ".join(copy), dt.datetime(2024, 1, 20))]
    got = {r[0]: r[1:] for r in _run(spark, rows)}
    assert got == {k: (f"a{i:03}", 2) for i in range(60) for k in (f"a{i:03}", f"b{i:03}")}


def test_a_hot_block_costs_a_row_a_copy(spark, monkeypatch):
    """A hundred thousand equal offers and 300 versions near one core give no pairs."""
    pairs = []
    plain = Du._similar_classes
    monkeypatch.setattr(Du, "_similar_classes", lambda *given: pairs.append(plain(*given)) or pairs[-1])
    day = "timestamp '2024-01-01 00:00:00' + (id % 20) * interval '1' day"
    text = "concat_ws(' ', transform(sequence(0, 119), k -> if(id >= 100000 and k = id % 120, concat('y', id), concat('w', k))))"
    frame = spark.range(100_300).selectExpr("cast(id as string) as offer_id", "'t' as title", "'c' as company_name", "'x' as commune_code", "'k' as contract_kind", f"{text} as description_text", f"{day} as source_published_at")
    rows = Du.probable_duplicates(frame).groupBy("cluster_id", "cluster_size").count().collect()
    assert [tuple(r) for r in rows] == [("0", 100_300, 100_300)] and pairs[0].count() == 0


def test_linked_groups(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 300)] + [(500, 500 + k) for k in range(1, 200)] + [(rng.randrange(800, 1200), rng.randrange(800, 1200)) for _ in range(300)] + [(7, 7)]
    rng.shuffle(links)
    least = _groups(1200, links)
    want = {i: least[i] for pair in links for i in pair}
    got = {r.member: r.group for r in L.linked_groups(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert L.linked_groups(spark.createDataFrame([], "a long, b long")).count() == 0
