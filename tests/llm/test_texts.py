import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lobule.llm import leakage, personal


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_matches_plain():
    rng = random.Random(0)
    left, right = [], []
    for _ in range(200):
        a = [rng.randrange(1, 4) for _ in range(rng.randrange(0, 30))]
        b = a[:]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), 9)
        left.append(np.array(a, np.uint32))
        right.append(np.array(b, np.uint32))
    assert leakage.banded_distances(left, right, 6).tolist() == [distance(list(a), list(b)) for a, b in zip(left, right)]


def exact(texts, items, n=8):
    out = {}
    for d, t in texts.items():
        w = leakage.words(t or "")
        grams = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
        for i, x in items.items():
            v = leakage.words(x or "")
            hit = set()
            for j in range(len(v) - n + 1):
                if tuple(v[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
            if hit:
                out[d, i] = len(hit) / len(v)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_no_word_run_is_lost(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "of", "it", "x1", "lobe", "ductule", "é", "ﬁne", "Straße", "42"]
    items = {i: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 40))) for i in range(12)} | {50: None, 51: ""}
    texts = {}
    for d in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))]
        v = (items[rng.randrange(12)]).split()
        at = rng.randrange(len(v))
        texts[d] = ", ".join(w[:10] + v[at : at + rng.randrange(1, 14)] + w[10:]).upper().replace("LOBE", "LO­BE")
    texts |= {90: None, 91: "", 92: "word " * 20000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("id", F.lit(1))
    got = leakage.leaks(docs, "doc_id", "text", spark.createDataFrame(list(items.items()), "item_id long, text string"))
    shares = {(r["doc_id"], r["item_id"]): r["word_share"] for r in got.collect() if r["word_share"] > 0}
    want = exact(texts, items)
    assert shares.keys() == want.keys() and all(abs(shares[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("low,high,edits", [(100, 118, 2), (119, 199, 2), (200, 400, 4)])
def test_altered_passages_are_kept(low, high, edits):
    """Passages of at least WINDOW characters with no more than two edits in any window, at any place of any document, are all found."""
    rng = random.Random(low)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(120))) for i in range(30)]
    index = leakage.Index(items, 8)
    pieces, want = [], set()
    for d in range(300):
        i = rng.randrange(30)
        n = rng.randrange(low, high + 1)
        at = rng.randrange(len(items[i][1]) - n)
        part = list(items[i][1][at : at + n])
        step = max(n // edits, 1)
        for e in range(edits):  # spread, so that no window holds more than two
            x = min(n - 1, e * step + rng.randrange(step)) if edits == 2 else e * step + step // 2
            part[x] = rng.choice(["", "", part[x] + "q", "z" if part[x] != "z" else "y"])
        pieces.append(" " + " ".join(word() for _ in range(rng.randrange(40))) + "".join(part) + " ".join(word() for _ in range(20)) + " \0")
        want.add((d, i))
    starts = np.cumsum([0, *map(len, pieces)])[:-1]
    codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
    found = leakage.regions(index, codes, starts, 8)
    assert len(want & found.keys()) >= 0.99 * len(want)


def test_altered_passage_is_aligned(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil magic potions near a frozen lake at dawn and nobody in the village hears the faint music drifting through the cold pines"
    altered = item.replace("wizards", "wizard").replace("village", "vilage")
    docs = spark.createDataFrame([(1, "noise " * 50 + altered + " noise" * 50), (2, "nothing of the sort " * 20)], "doc_id long, text string")
    got = leakage.leaks(docs, "doc_id", "text", spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [r["doc_id"] for r in got] == [1] and got[0]["char_share"] > max(0.97, got[0]["word_share"])


def test_items_in_blocks_and_none(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 60)
    items = {i: f"item number {i} speaks of many different things in one long sentence here" for i in range(5)}
    docs = spark.createDataFrame([(1, items[3])], "doc_id long, text string")
    got = leakage.leaks(docs, "doc_id", "text", spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert (1, 3, 1.0) in {(r["doc_id"], r["item_id"], r["word_share"]) for r in got.collect()}
    assert leakage.leaks(docs, "doc_id", "text", spark.createDataFrame([], "item_id long, text string")).count() == 0


CASES = [
    ("email", "write to jane.doe+lab@mail.example.org, please", "jane.doe+lab@mail.example.org"),
    ("email", "or write to sren at mail dot example dot org. Thanks", "sren at mail dot example dot org"),
    ("email", "cc tom_b (at) example.net; ok", "tom_b (at) example.net"),
    ("phone", "Contact: Anna Weber, +44 (0)20 7946 0924.", "+44 (0)20 7946 0924"),
    ("phone", "Call +1-973-555-0124 ext. 882 if it rings.", "+1-973-555-0124 ext. 882"),
    ("phone", "mobile 06.39.98.06.34, or", "06.39.98.06.34"),
    ("id_number", "Badge request: SSN 666-29-9172.", "666-29-9172"),
    ("id_number", "(passport no. XD0016032) on Monday", "XD0016032"),
    ("address", "deliver to Flat 25, 132 Rirrello Road, Rirrstead ZZ6 4QQ. Next", "Flat 25, 132 Rirrello Road, Rirrstead ZZ6 4QQ"),
    ("address", "stays at 207 Nildusk Court\nNildworth 00707 until May", "207 Nildusk Court Nildworth 00707"),
    ("address", "to Calle Brulvander 97, 1.º B, 00580 Brulford. End", "Calle Brulvander 97, 1.º B, 00580 Brulford"),
    ("name", "Operator Skedraville, Hiro noted dim tiles", "Skedraville, Hiro"),
    ("name", "Our visitor Dr. Peter von Drambhagen stays at home", "Peter von Drambhagen"),
    ("name", "Regards, L. O'Hara | lo@example.com | 555-0178", "L. O'Hara"),
]


@pytest.fixture(scope="module")
def fitted():
    return personal.models()


@pytest.mark.parametrize("kind, text, want", CASES)
def test_finds(fitted, kind, text, want):
    assert (kind, want) in {(personal.KINDS[k], " ".join(text[a:b].split())) for k, a, b in personal.detect([text], fitted)[0]}


@pytest.mark.parametrize("text", ["Run key 548-61-8979 was merged by label.", "Counter read 637.243.3769 ticks when it stopped.", "Zoom 57@0.45 NA; ping scope@rig25 in the chat.", "As in Gristoyan et al., density fell.", "Oil Red gave sharp signal, Victoria Blue none.", "The lot 62-6548 bottle and Cat. No. 256639 are empty.", ""])
def test_leaves_alone(fitted, text):
    assert personal.detect([text], fitted)[0] == []


# Sentences whose wording the training never uses, with all that is in them.
UNSEEN = [
    ("I met Sarah Thompson at the workshop in Leeds.", [("name", "Sarah Thompson")]),
    ("The package was handed over to Miguel Fernández yesterday.", [("name", "Miguel Fernández")]),
    ("Parcels go to 1600 Pennsylvania Avenue NW, Washington, DC 20500 only.", [("address", "1600 Pennsylvania Avenue NW, Washington, DC 20500")]),
    ("Unser Büro liegt Unter den Linden 77, 10117 Berlin, im Hof.", [("address", "Unter den Linden 77, 10117 Berlin")]),
    ("She moved to 221B Baker Street, London NW1 6XE in spring.", [("address", "221B Baker Street, London NW1 6XE")]),
    ("Nous habitons 12 rue de la Paix, 75002 Paris depuis mai.", [("address", "12 rue de la Paix, 75002 Paris")]),
    ("Ring me on 0161 496 0123 after six.", [("phone", "0161 496 0123")]),
    ("Sprechstunde unter +49 89 1234 5678 ab neun.", [("phone", "+49 89 1234 5678")]),
    ("Fax (415) 555-2671 is dead.", [("phone", "(415) 555-2671")]),
    ("Queries: helen.mirren@theatre.example please.", [("email", "helen.mirren@theatre.example")]),
    ("bob at workshop dot example is the old box", [("email", "bob at workshop dot example")]),
    ("His patient number 48213377 was on the wristband.", [("id_number", "48213377")]),
    ("Codice fiscale RSSMRA85T10A562S was stamped twice.", [("id_number", "RSSMRA85T10A562S")]),
    ("National insurance number QQ 12 34 56 C belongs to the tenant.", [("id_number", "QQ 12 34 56 C")]),
    ("Her driving licence no. MORGA657054SM was copied.", [("id_number", "MORGA657054SM")]),
    ("Steuer-ID 12 345 678 901 steht auf dem Bescheid.", [("id_number", "12 345 678 901")]),
    ("Both Emily Watson and Ravi Shankar declined.", [("name", "Emily Watson"), ("name", "Ravi Shankar")]),
    ("The keys are with Ludwig van Beethoven until noon.", [("name", "Ludwig van Beethoven")]),
    ("Interview with Professor A. Turing on machines.", [("name", "A. Turing")]),
    ("Minutes taken by O'Connor, Flannery last week.", [("name", "O'Connor, Flannery")]),
    ("The Western Blot and the Golgi Apparatus looked fine.", []),
    ("Part 4471-22-9981 of series 12/3456 broke.", []),
    ("Victoria Blue differs from Nile Red in water.", []),
    ("Version 10.4.2 needs 120 000 000 rows and 4096 columns.", []),
]


def test_unseen_wording(fitted):
    hit = got = true = 0
    for (text, want), spans in zip(UNSEEN, personal.detect([t for t, _ in UNSEEN], fitted)):
        found = {(personal.KINDS[k], text[a:b]) for k, a, b in spans}
        hit, got, true = hit + len(found & set(want)), got + len(found), true + len(want)
    assert hit / true >= 0.9 and hit / got >= 0.9, (hit, got, true)


def test_check_digits():
    assert personal.checked("12345678Z") and not personal.checked("12345678A") and personal.checked("X1234567L")
    assert personal.checked("1 85 05 78 006 084 91") and personal.checked("943 476 5919") and not personal.checked("943 476 5918")


def test_held_out_accuracy(fitted):
    made = personal.training(300, seed=99)
    got = [set(f) for f in personal.detect([t for t, _ in made], fitted)]
    hit, all_got, all_true = sum(len(g & t) for g, (_, t) in zip(got, made)), sum(map(len, got)), sum(len(t) for _, t in made)
    assert hit / all_got > 0.95 and hit / all_true > 0.93


def test_redacted_table(spark):
    rows = [(1, "Regards, Anna Weber | anna@example.com | 555-0178"), (2, None), (3, ""), (4, "nothing here"), (1, "Regards, Anna Weber | anna@example.com | 555-0178")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(0), "found": F.lit(0)})
    got = sorted(((r["id"], r["redacted"], len(r["found"])) for r in personal.redact(df, "doc_id", "text").collect()), key=str)
    assert got == [(1, "Regards, [NAME] | [EMAIL] | [PHONE]", 3)] * 2 + [(2, None, 0), (3, "", 0), (4, "nothing here", 0)]
    assert personal.redact(df.where("doc_id < 0"), "doc_id", "text").count() == 0


def test_long_text_is_read_whole(fitted):
    text = "Filler words go on. " * 20000 + "Contact: Anna Weber, +44 (0)20 7946 0924."
    assert {personal.KINDS[k] for k, _, _ in personal.detect([text], fitted)[0]} == {"name", "phone"}
