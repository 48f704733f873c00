import pytest
from pyspark.sql import functions as F

from strataform.llm import spam

PROSE = {
    "en": "The team will present the plan in the east office. Nobody has merged the report yet, which is why the desk asks for a copy. ",
    "de": "Das Team hat den Plan am Montag im Archiv vorgestellt. Niemand hat den Bericht gelesen, weil die Zahlen noch nicht passten. ",
    "fr": "Le support a relu le rapport après la réunion. Il faut environ une heure pour tout refaire avant la fin du mois. ",
    "es": "El equipo ha revisado el plan en la oficina. Nadie ha leído el informe porque las cifras no coincidían con la lista. ",
    "ja": "経理課は昨日の夕方に、監査の依頼により予算表を見直しました。変更の前に支援窓口へ一言お願いします。",
}
SPAM = [
    "cheap shoes sale shoes best shoes discount shoes online shoes buy shoes price shoes deals shoes " * 6,
    "#shoes #sale #lamp #mugs #chairs #online #cheap #best #deals #price #buy #new #outlet #top " * 3,
    "\n".join(f'<a href="https://a{i}.test/x">Lamp {i}</a><br>' for i in range(30)),
    "\n".join(f"- [Lamp sale](https://a{i}.test/x)" for i in range(30)),
    "Home > Lamps > Desk > Night > Sale\n" * 12,
    " ".join(f"https://a{i}.test/p/{i}" for i in range(40)),
    "tag:lamp cat:sale brand:mug color:red tag:cheap cat:new brand:best color:teal " * 5,
    "GardenHoseSale NightLightCheap DeskLampOnline BuyBestPrice RunningShoesDeals " * 6,
    "[lamp][sale][mug][cheap][chair][online][best][price][deals][buy][new][outlet]" * 3,
    "Avis lampe de bureau Velmora. Soldes tapis de yoga Praquinar. Promo moulin à café Taldal. Prix veste de pluie Osta. Meilleur coque de téléphone Quigo. " * 4,
    "soldes moulin à café meilleur avis tapis de yoga prix lampe de bureau veste de pluie acheter promo " * 4,
    "for the draft, the draft scope, the draft costs! " * 8,
    "人気 電話ケース, 最安値 電話ケース, 激安 電話ケース, 通販 電話ケース, 特価 電話ケース, " * 5,
]
GOOD = [
    PROSE["en"] * 3 + "\n\n- label the boxes\n- list what changed\n- close the tickets",
    "\n".join(f"label the boxes: Talrin, {i % 28 + 1}.{i % 12 + 1}." for i in range(30)),
    "\n".join(f"{i % 24:02d}:{i:02d} status ok queue {i}" for i in range(40)),
    "\n".join(f"garden hose | {i} x 12.{i:02d} | {i * 100}.00" for i in range(10, 40)),
    PROSE["en"] * 4 + "\n\n#one #two #three #four",
    "Only one short sentence stands here.",
]


@pytest.fixture(scope="module")
def shares(spark):
    background = [(1000 + i, (p * 4 + "\n\n") * 3, "d") for i, p in enumerate(list(PROSE.values()) * 8)]
    rows = [(i, t, "d") for i, t in enumerate(SPAM)] + [(100 + i, t, "d") for i, t in enumerate(GOOD)] + background
    rows += [(500, None, "d"), (501, "", "d"), (502, " 　\n", "d"), (503, "x" * 50_000, "d"), (0, SPAM[0], "d")]
    return spark.createDataFrame(rows, "doc_id long, text string, language string")


def test_found(shares):
    assert {r.doc_id for r in spam.spam_pages(shares).collect()} == set(range(len(SPAM)))


def test_shares_of_odd_texts(shares):
    got = {r.doc_id: r.junk_share for r in spam.judged(shares).collect()}
    assert 500 not in got and got[501] == 0 and got[502] == 0 and got[503] == 0
    assert all(got[1000 + i] == 0 for i in range(40))


def test_short_links_parted_by_blank_lines(spark):
    urls = [f"https://a{i}.test/p/{i}" for i in range(20)]
    rows = [(1, "\n\n".join(urls)), (2, PROSE["en"] + "\n\n" + "\n\n".join(urls)), (3, "\n\n".join(f"Lamp {i}\n\n{u}" for i, u in enumerate(urls)))]
    rows += [(4, PROSE["en"] * 4 + "\n\n" + "\n\n".join(urls[:8])), (5, "See there.\n\nhttps://a.test/p/1")]
    rows += [(100 + i, PROSE["en"] * 4) for i in range(8)]
    assert {r.doc_id for r in spam.spam_pages(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 2, 3}


def test_keywords_with_a_price_and_short_paragraphs(spark):
    words = "lamp shoes mug chair hose sale cheap best online deals price buy outlet discount reviews".split()
    line = " ".join(words[(i * 7 + i // 5) % 15] for i in range(300))
    rows = [(1, line + " $9"), (2, "\n\n".join(f"{words[i % 15]} {words[(i * 4 + 1) % 15]}" for i in range(60))), (3, "\n\n".join(PROSE["en"] for _ in range(3)))]
    rows += [(100 + i, PROSE["en"] * 4) for i in range(8)]
    assert {r.doc_id for r in spam.spam_pages(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 2}


def test_limits_follow_the_documents(spark):
    """The same page is judged by what its language usually shows: where all prose is terse, terse prose is no sign."""
    terse = "Plan ready. Costs known. Desk informed. Office closed. Report merged. Copy kept. Team told. Room locked. "
    rows = [(1, terse * 2)] + [(100 + i, PROSE["en"] * 4) for i in range(8)]
    assert {r.doc_id for r in spam.spam_pages(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1}
    rows = [(1, terse * 2)] + [(100 + i, terse * 2) for i in range(8)]
    assert spam.spam_pages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("sign", [*spam.SIGNS, *spam.PLAIN])
def test_every_sign_counts(spark, sign):
    usual = {c: 0.1 for c in ("words", *spam.SIGNS)} | {f"{c}_spread": 0.01 for c in spam.SIGNS}
    b = {m: 0.1 for m in spam.MEASURES} | {"words": 30.0, "glued": 0.0, "duplicate": 0.0}
    far = b | {sign: 0.0 if sign == "function" else 0.5}
    rows = spark.createDataFrame([(b, usual), (far, usual)], f"b struct<{', '.join(m + ' double' for m in spam.MEASURES)}>, u struct<{', '.join(c + ' double' for c in usual)}>")
    near, off = (r.s for r in rows.select(spam._score(F.col("b"), F.col("u")).alias("s")).collect())
    assert abs(near) < 1e-9 and off >= 1.5


def test_empty(shares):
    assert spam.spam_pages(shares.limit(0)).count() == 0


@pytest.mark.parametrize("lang", PROSE)
def test_language(lang):
    words = [w.lower() for w in spam._WORD.findall(PROSE[lang])]
    assert spam.language(words, PROSE[lang]) == lang
