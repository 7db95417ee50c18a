"""Residue: every notation and language once, talk about it, and what the corpus teaches."""

import random

import pytest

residue = pytest.importorskip("evalspark.llm.residue")

SCHEMA = "doc_id bigint, text string, key string, flag int"

CASES = [
    "Dear {{ customer_name }}, your order ${order_id} will reach %%CITY%% soon.",
    "Run <<model-name>> of model #{seed} finished with a score of <%= reward %>.",
    "Kind regards, [AGENT NAME]",
    "The item {{{item_name|default}}} is out of stock until {%- due_day -%}.",
    "Hello undefined, we have sent [object Object] back to your account.",
    "The batch is complete.\ncustomer name: TODO\ncity: ___",
    "Hola *|NAME|*, su pedido {0} llegará el __DATE__.",
    "注文｛｛order_id｝｝は14日たっても届いていません。",
    "<html><head><title>404 Not Found</title></head><body><h1>404 Not Found</h1><p>Too many requests came from your address.</p><hr></body></html>",
    "The threshold 0.5 escalated 12 percent of the turns.\n**Something went wrong\nPlease try again in a few minutes.**",
    "&lt;html&gt;&lt;body&gt;&lt;h1&gt;Zugriff verweigert&lt;/h1&gt;&lt;/body&gt;&lt;/html&gt;",
    '{"error": {"code": 403, "message": "You do not have permission to view this resource."}}',
    'Traceback (most recent call last):\n  File "render.py", line 3, in page\nRenderError: The server did not answer in time.',
    "<noscript>Turn on JS and reload this page.</noscript>",
    "YOU NEED TO ENABLE JAVASCRIPT TO RUN THIS APP.",
    "Veuillez  activer  JavaScript. Puis  rechargez  la  page.",
    "Lorem ipsum dapis velat caelo gravis.",
    "Text goes here. Placeholder body, to be written.",
    "asdf asdf asdf asdf asdf asdf",
    "Здесь будет текст.",
    "Loading...",
]

OTHERS = [
    None, "", "  \n ", "Good day, this is the order desk.",
    'The user typed "page not found again" and the agent explained how it handles moved pages.',
    "get_account_card answered 503 Service Unavailable 4 times on 9 June, the agent retried.",
    'A page that says "please enable JavaScript" is dropped by the crawler.',
    "Access denied is the right reply when the account of Hiazeil asks about an order of Gubark.",
    "We search for lorem ipsum in 40 tool descriptions and found none.",
    "The macro engine replaces {{order_id}} before a mail leaves.",
    'The word "undefined" in row 4 of the sheet means that there is no value.',
    "for seed in range(3):\n    print(f\"{seed}: {reward:.2f} of {total}\")",
    "<tool_call>\n{\"name\": \"work_out\", \"arguments\": {\"formula\": \"1 + 2\"}}\n</tool_call><|im_end|>",
    "Yes, go ahead with it. Yes, go ahead with it. Yes, go ahead with it. Yes, go ahead with it. Yes, go ahead with it.",
    "User: your site told me \"Access denied\" when I opened it.",
]


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], SCHEMA)
    rows = [r.doc_id for r in residue.residue_documents(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_cases_and_others(spark):
    texts = CASES + OTHERS
    assert sorted(found(spark, texts)) == list(range(len(CASES)))


def test_constant_marks_are_text_and_varying_marks_are_slots(spark):
    r = random.Random(1)
    names = ["first_name", "city", "order_id", "total"]
    said = [f"Reviewers keep {{{{token}}}} in file {r.randint(1, 99)} on purpose." for _ in range(8)]
    slots = [f"Parcel {{{{{r.choice(names)}}}}} left the depot of {i}." for i in range(8)]
    filled = ["Parcel 77 left the depot of 5.", "I would rather get 12.50 than wait."]
    once = ["I would rather get @@total@@ than wait."]
    texts = said + slots + filled + once
    assert found(spark, texts) == set(range(8, 16)) | {len(texts) - 1}


def test_copies_do_not_turn_an_answer(spark):
    unfilled = "Dear {{ first_name }}, order {{ order_id }} is on its way."
    guide = "Step {} of the guide: type your name into the box <your name>, then press send."
    for n in (1, 4, 12):
        texts = [unfilled] * n + [f"Parcel {i} was sent to __CITY__." for i in range(n)]
        assert found(spark, texts + [guide.format(i) for i in range(n)]) == set(range(2 * n))


def test_long_records_show_that_a_place_is_filled(spark):
    long = "The template of this parcel note says that {} waits at the depot" + " and that nobody has asked for it so far" * 12 + "."
    assert found(spark, [long.format("{{ item }}"), long.format("77"), "fine"]) == {0}


def test_page_sentences_are_learnt_from_company(spark):
    pages = [f"Page not found\nThe aardvark has left the building.\nReference {i}" for i in range(6)]
    alone = ["The aardvark has left the building."]
    common = ["We counted them."] * 30
    assert found(spark, pages + alone + common) == set(range(7))


def test_no_rows_and_extra_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert residue.residue_documents(df).count() == 0
    two = spark.createDataFrame([(1, "Loading...", "k", 1), (2, "fine", "k", 1)], SCHEMA)
    assert [tuple(r) for r in residue.without_residue(two).collect()] == [(2, "fine", "k", 1)]


HELD_OUT = ["Ukurasa haujapatikana", "Seva haijibu kwa wakati.", "Sivua ei löytynyt", "Palvelin ei vastaa ajoissa."]  # Swahili and Finnish, of which no word is fixed


def test_languages_without_fixed_words_are_learnt(spark):
    swahili = [f"404 Ukurasa haujapatikana\nSeva haijibu kwa wakati.{' Kisha rudi' * i}" for i in range(4)]
    finnish = [f"<html><h1>404 Sivua ei löytynyt</h1><p>Palvelin ei vastaa ajoissa.</p><p>{'Palaa ' * (i + 1)}</p></html>" for i in range(4)]
    others = [f"Habari ya asubuhi, namba {i} iko tayari." for i in range(5)] + ["Palaa", "Kisha rudi", "Order 404 was sent"]
    texts = swahili + finnish + HELD_OUT + others
    assert not any(residue.page_segment(t) for t in HELD_OUT)
    assert found(spark, texts) >= set(range(12)) and not found(spark, texts) & set(range(12, 12 + 5)) and len(texts) - 1 not in found(spark, texts)


GENERAL = [
    "404 Pagina non trovata", "404 Pagina niet gevonden", "请启用JavaScript。", "JavaScript를 활성화하세요.", "This page isn't working", "This site can't be reached", "You have been blocked", "502 Bad Gateway nginx",
    "Error establishing a database connection", "Please enable cookies to continue", "Sed ut perspiciatis unde omnis iste natus error", "Qui va il testo.", "Sunucu yanıt vermiyor.", "HTTP 503", "Strona nie istnieje.",
]


@pytest.mark.parametrize("text", [t for t in GENERAL if t != "HTTP 503"])
def test_fixed_words_join_in_sentences_never_seen(text):
    assert residue.page_segment(text)


def test_what_varies_is_no_page_segment():
    for text in ["The page of order 77 was not found.", "We search for lorem ipsum in 40 descriptions.", 'He said "access denied".', "The text is about a lamp.", "My session with the dentist was fine.", "."]:
        assert not residue.page_segment(text)


def test_long_segments_count_like_short_ones(spark):
    long = "This page requires scripts" + " and it has always done so" * 60 + "."
    marked = "Dear {{ name }}," + " we are glad to have you with us" * 40 + "."
    assert found(spark, [long, marked, "fine"]) == {0, 1}
