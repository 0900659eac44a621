"""Truncation, residue, page furniture and moderation on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratakb.llm import furniture, moderation, residue, truncation
from stratakb.llm import lines as L
from stratakb.session import table

PROSE = ["The cache keeps every page until the index has been rebuilt.", "Readers ask why the queue is flushed twice.", "Set the limit to 4 if the worker should wait.", "Most pages are stored by the crawler; the rest stay remote."]


# --- truncation --------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "verdict"),
    [
        ("One sentence. The second one breaks o", "open"),
        ("One sentence. Another that is wh…", "mark"),
        ("One sentence. Another that [...]", "mark"),
        ("One sentence. Another with a broken �", "mark"),
        ("One sentence. See [the guide](https://", "mark"),
        ("A full sentence.", "whole"),
        ("这是一个完整的句子。", "whole"),
        ("第一句。第二句没有写完", "open"),
        ("Overview of caches", "clause"),
        ("Text.\n- an item", "whole"),
        ("Text.\n| a | b |", "whole"),
        ("Text.\n```\ncode", "whole"),
        ("Text.\n# Heading", "whole"),
        ("Text.\n(c) 2024 Somebody", "whole"),
        ("Error 404", "whole"),
        ("Text. In version 5.", "open"),
    ],
)
def test_endings(text, verdict):
    assert truncation.ending(text)[0] == verdict


def test_truncated(spark):
    schema = "chunk_id string, source string, title string, summary string, content string"
    rows = []
    for i in range(400):
        whole = f"{PROSE[i % 4]} Number {i % 7} stays. " + "x" * (i % 90) + "."
        rows.append((f"c{i:03d}", "h", "t", whole, whole))
    for i in range(30):
        rows.append((f"k{i:02d}", "h", "t", (" ".join(PROSE))[:200], "Done."))  # a field limit
    rows += [("n", None, None, None, "")] + [rows[0]] + [("np", "h", "t", "Overview of caches", "Most pages are st")]
    df = spark.createDataFrame(rows, schema)
    got = {(r.chunk_id, r.field) for r in truncation.truncated(df).collect()}
    assert got == {(f"k{i:02d}", "summary") for i in range(30)} | {("np", "content")}
    limits = truncation.spikes(truncation.value_ends(df)).where("unit = 'chars' and field = 'summary'").collect()
    assert {r.length for r in limits} == {200 - (len((" ".join(PROSE))[:200]) - len((" ".join(PROSE))[:200].rstrip()))} or {r.length for r in limits} == {200}
    rates = {(r.source, r.field): (r.filled, r.cut) for r in truncation.source_rates(df).collect()}
    assert rates[("h", "summary")] == (431, 30) and rates[("h", "content")] == (431, 1)
    assert truncation.truncated(df.limit(0)).count() == 0


def test_the_spike_decides(spark):
    """The same kind of clause is cut at a spike of its source and whole elsewhere."""
    clause = "Zorbal pages of the wide index that the crawler has kept since"
    rows = [(f"w{i:03d}", "usual", "t", f"Zorbal {'x' * (i % 30)} pages are kept." if i % 5 == 0 else f"Zorbal {'x' * (i % 30)} pages", "Done.") for i in range(300)]
    rows += [(f"k{i:02d}", "h", "t", f"{clause} {i:02d} years and more"[:60], "Done.") for i in range(40)]
    rows += [(f"o{i:02d}", "other", "t", f"{clause} {i:02d} years and more"[:60] + "y" * (3 * i), "Done.") for i in range(40)]
    df = spark.createDataFrame(rows, "chunk_id string, source string, title string, summary string, content string")
    got = truncation.truncated(df).collect()
    assert {r.chunk_id for r in got} == {f"k{i:02d}" for i in range(40)} and all(r.at_limit for r in got)


def test_names_and_long_lines():
    assert truncation.opening("Quorvex Hub keeps") == truncation.opening("OrmereDB keeps") == "<name>"
    assert truncation.opening("The Hub keeps") == "the" and truncation.opening("der Speicher") == "der"
    long = "word " * 200
    assert truncation.ending(f"One sentence. Another {long}…")[0] == "mark"
    assert truncation.ending("Text.\n- One sentence. Another that is wh")[0] == "open"


# --- residue -----------------------------------------------------------------------------------------

PLACEHOLDERS = "{{ name }}|${user.name}|[[title]]|<%= x %>|#{price}|%CUSTOMER%|{%item%}|%(name)s|@@ITEM@@|<<SITE NAME>>|__TEAM__|{site_name}|[INSERT NAME HERE]|[Your Company]|[DOC TITLE]|<contact email here>|[object Object]|XXXXX|(add owner)|«company»".split("|")


@pytest.mark.parametrize("mark", PLACEHOLDERS)
def test_placeholders(mark):
    assert residue.has_placeholder(f"Dear {mark}, your order is here.")
    assert not residue.has_placeholder(f"Write `{mark}` in the template.")
    assert not residue.has_placeholder(f"Text.\n```\n{mark}\n```\nMore.")


@pytest.mark.parametrize("text", ["TODO comments are counted.", "The list [1] and (see below).", "Use a[0] and <b>bold</b> x < y > z.", "100% of [users](https://x.example)", "", "« bonjour »"])
def test_no_placeholders(text):
    assert not residue.has_placeholder(text)


@pytest.mark.parametrize("text", ["TODO: describe the cache.", "To be completed: the name.", "待补充：名称。"])
def test_stubs(text):
    assert residue.has_placeholder(text)


@pytest.mark.parametrize(
    "text",
    ["404 Not Found", "# A title\n\nAccess denied", "Please enable JavaScript to view this page.", "页面不存在\n访问被拒绝", "Lorem ipsum dolor sit amet. Magna aliqua velit. Ut.", "Request timed out nginx", "这里是占位文本，请替换为正式内容。", "undefined", "(no content yet)", "Seite nicht gefunden", "**TOO MANY REQUESTS Just a moment", "blah " * 200, "占位文本\n" * 100, "test test 123"],
)
def test_whole_residue(text):
    assert residue.is_whole_residue(text)


@pytest.mark.parametrize("text", ["", *PROSE, 'The error "access denied" in the log is harmless here.', "When the server answers 503 Service Unavailable, the worker backs off.", "Pages that ask visitors to enable JavaScript are fetched a second time.", "Lorem ipsum is the filler that designers use.", "# Title\n\n404 Not Found\n\n" + PROSE[0]])
def test_texts_about_residue(text):
    assert not residue.is_whole_residue(text)


def test_pieces():
    assert residue.pieces("# A title\nAccess denied Incident id: 9da3aee2\nTrace: at /a/b line 4 Go home.") == [("access denied", True), ("incident id: 0", False), ("trace: at 0 line 0", False), ("go home", False)]
    assert residue.pieces("访问被拒绝 错误代码：2954 返回首页 请稍后。再见") == [("访问被拒绝", True), ("错误代码：0", True), ("返回首页", False), ("请稍后", False), ("再见", False)]
    assert residue.pieces(" \n ") == []


def test_the_pretest_follows_from_the_patterns():
    assert len(residue.STRONG_FORMS) == sum(len(L.alternatives(p.pattern)) for p in residue.STRONG)
    for pattern, bit in residue.STRONG_FORMS:
        needed = residue._needed(residue.re._parser.parse(pattern.pattern))
        assert bit > 1 and needed
        for word in needed:
            assert residue._hints(f"so {word}x so") & bit
    assert residue._needed(residue.re._parser.parse(r"ab?c(?:de|fg)h*")) in ({"de", "fg"},)
    assert residue._needed(residue.re._parser.parse(r"a*|b")) is None


HEADS = ["404 Not Found", "Access denied", "Bad gateway", "Session expired"]
REST = ["Zumbal the page has gone elsewhere.", "Grelp to the porch. Ref 9da3aee2", "Vromple for 27 seconds."]


def test_companions_are_learned(spark):
    """What stands on residue pages and hardly elsewhere is found though no list knows it; an article that quotes a page teaches nothing."""
    rows = [("chunks", f"k{i}", f"# Title {i}\n{HEADS[i % 4]}\n{REST[i % 3]}") for i in range(24)]
    rows += [("qa_answers", "mixed", f"{REST[0]}\n{REST[1].replace('9da3aee2', '0badc0de')}"), ("chunks", "alone", REST[2].replace("27", "4"))]
    quoting = f"{PROSE[0]} {PROSE[1]} {PROSE[2]} {PROSE[3]}\n404 Not Found\n"
    rows += [("chunks", f"q{i}", quoting) for i in range(4)] + [("chunks", "text", PROSE[0]), ("chunks", "part", f"{REST[0]} {PROSE[2]}")]
    df = spark.createDataFrame(rows, "record_table string, record_id string, text string")
    got = {r.record_id: r.way for r in residue.judged_records(df).collect()}
    assert got == {f"k{i}": "companions" for i in range(24)} | {"mixed": "companions", "alone": "companions"}


def test_labels_spread_to_near_copies(spark):
    """Near copies of a learned notice, in no list and with no piece in common, are reached through SimHash, text similarity and components."""
    notice = "bramble the harbour is closed for the whole season and all visitors are asked to come back when the tide has turned once more"
    rows = [("chunks", f"k{i}", f"404 Not Found\n{notice}.") for i in range(3)] + [("chunks", "bare", notice)]
    rows += [("chunks", "odd", f"{notice} today"), ("qa_answers", "odder", f"{notice} today friends"), ("chunks", "far", "bramble the harbour is open " + PROSE[0])]
    rows += [("chunks", "a", None), ("chunks", "b", "  "), rows[0], ("qa_answers", "f", "Dear {{ name }}."), (None, "g", None), ("chunks", "h", "???")]
    df = spark.createDataFrame(rows, "record_table string, record_id string, text string").withColumn("cls", F.lit(1)).withColumn("title", F.lit(2))
    got = {r.record_id: r.way for r in residue.judged_records(df, hamming=12).collect()}
    assert got == {"k0": "companions", "k1": "companions", "k2": "companions", "bare": "companions", "f": "placeholder", "odd": "spread", "odder": "spread"}
    assert residue.residue(df.limit(0)).count() == 0


def test_simhash():
    words = [np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (1, 2, 70, 3)] * 40
    assert [residue.simhashes([w])[0] for w in words] == list(residue.simhashes(words))


# --- page furniture ----------------------------------------------------------------------------------


def page(i, body):
    top = ["Skip to main content", "Home | Docs | Blog | Contact", f"Home > Docs > Page {i}", "We use cookies to improve your visit. Accept all | Reject"]
    end = ["Related articles", f"Other page {i}", f"- Third page {i}", "", f"Was this page helpful? Yes No", f"Page {i} of 30", "Privacy policy | Terms of use", "© 2024 Somebody"]
    return "\n".join([*top, "", f"# Heading {i}", "", *body, "", *end])


def test_furniture(spark):
    rows, want = [], set()
    for i in range(12):
        body = [f"Sentence {i} about {'abcdefghijkl'[i] * 9} and more of it.", "Tip: run the check twice if the first result looks wrong.", "```", "x = 1", "```", "* a list item"]
        text = page(i, body)
        rows.append((f"d{i}", f"d{i}-1", "h.example", f"https://h.example/docs/p{i:02d}", text))
        article = {"", f"# Heading {i}", *body}
        want |= {(f"d{i}-1", n) for n, line in enumerate(text.split("\n"), 1) if line not in article}
    rows += [("u", "u-1", "user-upload", None, page(1, ["Own text."])), ("n", None, "h.example", None, "Home"), ("m", "m-1", None, None, "Home"), ("e", "e-1", "h.example", None, None), rows[0]]
    df = spark.createDataFrame(rows, "doc_id string, chunk_id string, source string, url string, content string")
    found = furniture.furniture_lines(df)
    got = {(r.chunk_id, r.line_no) for r in found.collect()}
    assert got == want
    clean = {r.chunk_id: r.content for r in furniture.without_lines(df, found).collect() if r.chunk_id}
    assert "Skip to" not in clean["d3-1"] and "* a list item" in clean["d3-1"] and clean["u-1"].startswith("Skip to") and clean["e-1"] is None
    assert furniture.furniture_lines(df.limit(0)).count() == 0


def test_furniture_without_words(spark, monkeypatch):
    """Lines of the page are found by what neighbouring pages share, even if no word list knows them."""
    rows, want = [], set()
    for i in range(12):
        top = ["Zorbal bentuk", f"Kwelt / Vrom / Drusk {i}", "Wij gebruiken wat kruimels op deze site, ga daarmee akkoord.", ""]
        body = [f"# Heading {i}", "", f"Sentence {i} about {'abcdefghijkl'[i] * 9} and more of it.", "* a list item", ""]
        end = ["Plimpton reads", f"- Other page {i}", f"Odd {'abcdefghijkl'[i]} title", "", "Grolsch | Trink | Frob"]
        rows.append((f"d{i}", f"d{i}-1", "h.example", f"https://h.example/docs/p{i:02d}", "\n".join(top + body + end)))
        want |= {(f"d{i}-1", n) for n in (1, 2, 3, 10, 11, 12, 14)}
    df = spark.createDataFrame(rows, "doc_id string, chunk_id string, source string, url string, content string")
    assert all(L.furniture_kind(line) is None for r in rows for line in r[4].split("\n"))
    judged = furniture.judged_lines(df).collect()
    assert {(r.chunk_id, r.line_no) for r in judged} == want
    assert {r.way for r in judged} == {"shared", "below"}


def test_lines_that_differ_late_have_keys_of_their_own():
    long = "word " * 60
    assert furniture.line_key(long + "a", []) != furniture.line_key(long + "b", [])


def test_copies_of_an_article_are_not_compared(spark):
    body = [f"Line {k} of an article that several addresses carry word for word." for k in range(8)]
    rows = [(f"d{i}", f"d{i}-1", "h.example", f"https://h.example/a{i}", "\n".join([*body, "Short label"])) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_id string, source string, url string, content string")
    assert furniture.furniture_lines(df).count() == 0


def test_common_subsequence():
    assert furniture.longest_common(list("abcde"), list("xbdyce")) in ([(1, 1), (3, 2), (4, 5)], [(1, 1), (2, 4), (4, 5)])
    assert furniture.longest_common([], ["a"]) == []


@pytest.mark.parametrize("line", ["The fetcher drops the cookie banner before it measures the text.", "Our privacy review asks who may read the transcript.", "A session cookie is kept for 4 minutes.", "## Related articles", "| Home | Docs |", ""])
def test_article_lines(line):
    assert L.furniture_kind(line) is None


# --- moderation --------------------------------------------------------------------------------------


@pytest.mark.parametrize(("text", "plain"), [("v.e.r.m.i.n", "vermin"), ("d1ckh34d", "dickhead"), ("imbeciiile", "imbecile"), ("b*****d", "bastard"), ("blоwjоb", "blowjob"), ("f u c k you", "fuck you"), ("ab​c", "abc"), ("**Q** why?", "**q** why?"), ("Привет", "привет")])
def test_canonical(text, plain):
    assert moderation.canonical(text) == plain


def test_noisy_or():
    assert moderation.noisy_or([]) == 0.0
    assert abs(moderation.noisy_or([0.0, 0.0]) - 0.75) < 1e-9
    assert moderation.noisy_or([-50.0] * 1000) < 1e-12


def test_model_finds_the_sentence_and_unseen_forms(spark):
    good, bad = labelled()  # the weights are learned, so the sample holds some of each kind
    rows = [(t, 0) for t in good] + [(t, 1) for t in bad] + [(PROSE[0], None), (None, 1), (" ", 1)]
    model = moderation.train(spark.createDataFrame(rows, "text string, label int"))
    held_out = {"You stupid moron, drop dead.": True, "Ausländer sind Ungeziefer.": True, "你全家都是蠢猪，不得好死。": True, "The master node kills the slave process.": False, PROSE[3]: False}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(held_out)] + [(90, None), (91, ""), (92, f"{PROSE[0]} Shut up, you idiot. {PROSE[1]}")], "doc_id long, text string")
    got = {r.doc_id: r for r in moderation.score(docs, model).collect()}
    assert [got[i].score >= moderation.THRESHOLD for i in range(len(held_out))] == list(held_out.values())
    assert got[90].score == got[91].score == 0.0 and got[92].sentence_no == 2


@pytest.mark.parametrize(
    ("sentence", "feature"),
    [(s, "hostile") for s in ("get lost", "shut up", "halt die klappe", "leck mich", "casse-toi", "vete al carajo", "cierra la boca", "闭上你的狗嘴")]
    + [(s, "sex") for s in ("clothes off", "on her knees", "come to bed")]
    + [("they should be shot", "harm"), ("girls are dumb", "group+demean"), ("you idiot", "aimed")],
)
def test_features(sentence, feature):
    found = moderation.features(sentence, moderation.WORD.findall(sentence))
    assert feature in found or "+".join(reversed(feature.split("+"))) in found
    assert set(found) <= set(moderation.FEATURES)


def test_endings_bound_stems():
    assert "insult" in moderation.CATEGORIES["idiots"] and "group" in moderation.CATEGORIES["foreigners"]
    assert not moderation.CATEGORIES["pigment"] and not moderation.CATEGORIES["idiotypenhaus"]


BAD = ["You are a worthless loser, get lost.", "You stupid bitch, drop dead.", "All women are vermin.", "Foreigners are filthy rats.", "Migrants are a plague.", "Watch my porn video, naked blowjob.", "Nobody wants you here, you idiot."]


def labelled():
    good = [f"{a} {b}" for a in PROSE for b in PROSE] + ["Kill the child process if it hangs.", "Sex education material was read by nurses."]
    return good, [f"{a} {b}" for a in PROSE for b in BAD]


def test_labels_decide():
    """The weights come from the labels: without rows, or with the labels the other way round, the same sentence is no case."""
    good, bad = labelled()
    sentence = f"{PROSE[0]} You are a filthy bastard, go to hell. {PROSE[1]}"
    score = lambda model: moderation.noisy_or(model.logits(sentence))
    assert score(moderation.fit([], [])) < 0.01
    assert score(moderation.fit(good + bad, [0] * len(good) + [1] * len(bad))) > 0.9
    assert score(moderation.fit(good + bad, [1] * len(good) + [0] * len(bad))) < moderation.THRESHOLD
    assert moderation.noisy_or(moderation.fit([], []).logits(" ".join(PROSE) * 200)) < moderation.THRESHOLD


def test_without_the_lexicon_words_are_learned():
    good, bad = labelled()
    model = moderation.fit(good + bad, [0] * len(good) + [1] * len(bad), lexicon=False, gram_scale=1.2)
    assert moderation.noisy_or(model.logits(f"{PROSE[2]} You are a worthless loser. {PROSE[3]}")) >= moderation.THRESHOLD
    assert moderation.noisy_or(model.logits(f"{PROSE[2]} {PROSE[3]}")) < moderation.THRESHOLD


def test_wrong_labels_are_left_out():
    good, bad = labelled()
    texts, labels = good + bad, [0] * len(good) + [1] * len(bad)
    odd = "The wide cache of Belmont can sustain 40 requests."
    model = moderation.fit(texts + [odd], labels + [1])
    assert moderation.noisy_or(model.logits(odd)) < moderation.THRESHOLD


@pytest.fixture(scope="module")
def sample(spark):
    rows = table(spark, "/root/testdata/sf0.001", "moderation_examples").where("label is not null and length(trim(text)) > 0")
    return [(r.text, r.label) for r in rows.orderBy("example_id").collect()]


def test_look_alikes_that_the_sample_lacks_are_no_cases(sample):
    rows = [(t, y) for t, y in sample if not any(w in t.lower() for w in ("puppies", "willow"))]
    model = moderation.fit([t for t, _ in rows], [y for _, y in rows])
    for text in ("A dog breed, a bitch with 388 puppies, is filed under animals.", "Pussy willow and cock pheasant were two of the 12 odd tags in the nature corpus.", "The farm keeps a cock, three hens and a bitch with her puppies.", "A naked body is shown to students of medicine."):
        assert moderation.noisy_or(model.logits(f"{PROSE[0]} {text} {PROSE[1]}")) < moderation.THRESHOLD


def test_forms_that_the_sample_lacks_are_found(sample):
    model = moderation.fit([t for t, _ in sample], [y for _, y in sample])
    bad = ["Kick those refugees out.", "This town would be nicer without gypsies.", "Migrants belong at the end of a noose.", "He ripped off her panties and she begged for more.", "Everyone who knows you must be tired of you.", "Die Ausländer taugen nichts.", "Las mujeres no valen para nada.", "Te voy a romper los dientes."]
    assert [t for t in bad if moderation.noisy_or(model.logits(f"{PROSE[0]} {t} {PROSE[1]}")) < moderation.THRESHOLD] == []
    good = ["Women and refugees read the page.", "The parcel was sent back out of stock.", "The rope and the crates are kept on the ship.", "Take the labels off the dress.", "Der Rest wurde nach Hause geschickt."]
    assert [t for t in good if moderation.noisy_or(model.logits(f"{PROSE[0]} {t} {PROSE[1]}")) >= moderation.THRESHOLD] == []


def test_ambiguous_words_are_read_by_their_sentence():
    found = lambda s: moderation.features(s, moderation.WORD.findall(s))
    assert "insult" not in found("the bitch and her puppies sleep in the kennel") and "insult" in found("you bitch, go back to the kennel with your puppies")
    assert "demean" not in found("the dumb terminal is old") and "demean" in found("women are dumb")
    assert "demean" in found("send the refugees back") and not found("send the page back")
    assert "demean" in found("we were safer without immigrants") and "demean" not in found("disabled people use the reader without a mouse")
