"""Cases of the review: what the llm operators once left out."""

from __future__ import annotations

import random

import pytest

from corpusloom.llm import furniture, variants
from tests.llm.test_llm import ENTITIES, site

FIRST = ["ann", "bob", "cyd", "dora", "egon", "finn", "gwen", "hugo", "ines", "jan", "kira", "leo"]
LAST = ["oakfield", "elmhurst", "ashgrove", "birchwood", "cedarling", "dunmore", "eastvale", "farrow", "glenholm", "hartwick"]
WORDS = [f"{a}{b}" for a in "bdfgklmprst" for b in ("arlo", "ento", "ilum", "ustra", "ovent")]


def pages(rng, many, lines_of):
    """Texts of own words, and the (row, line) of the lines that ``lines_of`` puts behind them."""
    texts, want = [], set()
    for i in range(many):
        lines = [" ".join(rng.choices(WORDS, k=rng.randint(6, 40))).capitalize() + "." for _ in range(rng.randint(1, 4))]
        for line in lines_of(i):
            want.add((i, len(lines)))
            lines.append(line)
        texts.append("\n".join(lines))
    return texts, want


def found(spark, texts, source="s.example"):
    return {tuple(r) for r in furniture.repeated_lines(site(spark, texts, source), "chunk_idx", "source", "text").collect()}


def people(rng, many):
    return rng.sample([f"{a} {b}" for a in FIRST for b in LAST], many)


def test_furniture_of_a_site_named_by_a_byline_word(spark):
    rng = random.Random(7)
    who = people(rng, 60)
    texts, want = pages(rng, 120, lambda i: [f"Asked about this page? Write to {who[i // 2]} at the Marlobrin Desk office"] if i % 2 else [])
    authors = people(rng, 30)
    texts = [t + (f"\nPosted by {authors[i % 30]} on 3 March 2024" if i % 3 == 0 else "") for i, t in enumerate(texts)]
    assert found(spark, texts, "marlobrin-desk.example") == want


def test_byline_by_its_shape():
    for head, tail in [("by ", ", staff writer"), ("posted by ", " on 0"), ("words: ", ". pictures: the staff writer"), ("posted by ann ", " on 0"), ("frances ", " | field correspondent"), ("", " oak - technology desk")]:
        assert furniture._byline(head, tail, "marlobrin-desk.example"), (head, tail)
    for head, tail in [("you are reading: ", " - marlobrin desk"), ("write to ", " at the marlobrin desk office"), ("write to ", " at the reader desk office"), ("text size and photos are fixed for all of ", " in print")]:
        assert not furniture._byline(head, tail, "marlobrin-desk.example"), (head, tail)


@pytest.mark.parametrize("words", [40, 150, 2000])
def test_furniture_in_long_lines(spark, words):
    rng = random.Random(words)
    notice = " ".join(rng.choices(WORDS, k=words))
    marked = f"<p class='note'><b>{notice}</b></p>"
    slipped = notice[:20] + "x" + notice[20:-20] + notice[-19:]
    texts, want = pages(rng, 60, lambda i: [[notice, marked, slipped.upper()][i % 3]] if i % 4 == 0 else [])
    assert found(spark, texts) == want


def test_alike_equals_levenshtein():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(3)
    for _ in range(4000):
        a = "".join(rng.choices("ab", k=rng.randint(0, 9)))
        b = "".join(rng.choices("ab", k=rng.randint(0, 9)))
        assert all(furniture._alike(a, b, most) == (edits(a, b) <= most) for most in range(5)), (a, b)
    long = "".join(rng.choices("abcdef", k=400))
    assert furniture._alike(long, long[:10] + "x" + long[10:380] + long[381:], 2)


def test_dates_in_long_lines_are_alike():
    start = "The rules that hold for the use of these pages, for what is cited from them and for all that is sent to their makers were last revised on"
    ways = ["3 March 2024", "Monday, 14 October 2019", "May 7th, 2021", "2020-01-31", "Sat 1st Dec. 2018", "December 12, 1999"]
    counts = ["three", "no", "Twenty", "17", "seventeen"]
    lines = [f"{start} {way} and read {count} times since" for way in ways for count in counts]
    assert len(lines[0]) > 160 and {own[0] for own in furniture.plain(lines)} == {f"{start.lower()} 0 and read 0 times since"}
    assert furniture.plain(["none of the marches, twoness, 1 marble"]) == [["none of the marches, twoness, 0 marble"]]


def test_every_leader_that_may_match_is_tried():
    rng = random.Random(4)
    heads = [f"share this page with all of your readers on {word}" for word in WORDS]
    leaders = furniture.Leaders([furniture.Leader(h) for h in heads] + [furniture.Leader("you are reading: ", " - marlo review"), furniture.Leader("ok go")])
    for i, head in enumerate(heads):
        at = rng.randrange(len(head) - 5, len(head))
        for line in (head[:at] + head[at + 1 :], head.replace("page with", "pagewith")):
            fits = [j for j, leader in enumerate(leaders.leaders) if leader.matches(line)]
            assert i in fits and leaders.find(line) in fits, line
    lines = ["okgo", "you are readin", "yuo are reading: the end - marlo review", "share this", "shre thispage wihall of your readers on barlo"]
    for line in lines:
        fits = [j for j, leader in enumerate(leaders.leaders) if leader.matches(line)]
        assert (leaders.find(line) in fits) if fits else leaders.find(line) == -1, line


def test_varying_lines_beyond_many_with_one_opening(spark):
    rng = random.Random(9)
    kinds = [f"Read more about {word} and all that goes with {other} on" for word, other in zip(WORDS[:9], WORDS[20:], strict=False)]

    def lines(i):
        out = [f"{kind} {' '.join(rng.choices(WORDS, k=2))}" for kind in kinds]
        return [*out, f"Read more in the wide archive of the house: {' '.join(rng.choices(WORDS, k=2))}"] if i % 4 == 0 else out

    texts, want = pages(rng, 120, lines)
    assert found(spark, texts) == want


def test_long_title_in_a_line(spark):
    rng = random.Random(12)
    texts, want = pages(rng, 120, lambda i: [f"You are now reading this article in the archive of the Marlobrin Review: {' '.join(rng.choices(WORDS, k=7))} - all rights are with the authors"] if i % 3 == 0 else [])
    assert found(spark, texts) == want


def test_a_core_near_two_known_cores_goes_where_its_details_agree(spark):
    data = [(1, "Joseph Funmartomga"), (2, "Joe Funmartomga"), (3, "Funmartomga, Joseph"), (4, "Katherine Funmartombo"), (5, "Katherine Funmartomgo"), (6, "Joseph Funmartomgo")]
    chain = ["Marta Kelvinastorbe", "Marta Kelvinastorb", "Marta Kelvinastor", "Marta Kelvinasto", "Marta Kelvinast", "Marta Kelvinas"]
    rows = [(i, n, n, "Person", None) for i, n in data + [(20 + i, n) for i, n in enumerate(chain)]]
    given = spark.createDataFrame([("Katherine", "Kate"), ("Joseph", "Joe"), ("Marta", "Mart")], "given string, short_form string")
    things = {r.entity_id: r.thing for r in variants.resolve(spark.createDataFrame(rows, ENTITIES), given).collect()}
    assert things == {1: 1, 2: 1, 3: 1, 6: 1, 4: 4, 5: 4} | {20 + i: 20 for i in range(6)}
