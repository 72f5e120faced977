import re

from rivulet.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def test_base_counts(docs, edges):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for df in (docs, edges.where("doc_id < 9 or doc_id > 10 or doc_id is null")):
        want = sorted(((r["doc_id"], *brute(r["text"])) for r in df.collect()), key=str)
        assert sorted((tuple(r[n] for n in names) for r in Q.line_first_cleaning(df).collect()), key=str) == want


def test_whole_long_texts_and_nothing(edges, nothing):
    n = {r["doc_id"]: r["n_words"] for r in Q.line_first_cleaning(edges).collect()}
    assert n[9] == 60_000 and n[10] == 60_001
    assert Q.line_first_cleaning(nothing).collect() == [] and Q.clean_documents(nothing).collect() == []


def test_lines_go_first_then_documents(spark):
    said = ["A calm story about ships begins where the harbour ends.", "Old friends tell it while ropes dry in the sun.", "Nobody remembers who sang first, or why the birds left.", "Later the wind turned, and salt covered every window.", "My uncle kept two nets, one for luck and another for work.", "Stars came out before anyone had lit a lamp.", "In the morning we counted boats and found that none was missing."]
    prose = "\n".join(said)
    bad = "Home | About | Contact | Login\nAll rights reserved.\n#### $$$$ %%%%\nCLICK HERE NOW TO READ MORE ABOUT EVERYTHING"
    rows = [(1, prose, 5), (2, prose + "\n" + bad, 5), (3, "\n".join([bad.replace("Home", f"Home{i}") for i in range(30)]) + "\n" + prose, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    assert {r["doc_id"]: r["kept"] for r in Q.line_first_cleaning(df).collect()} == {1: True, 2: True, 3: False}
    kept = {r["doc_id"]: r for r in Q.clean_documents(df).collect()}
    assert kept[1]["text"] == prose and kept[2]["text"] == prose and kept[2]["n_chars"] == len(prose)


def test_suspicion_misses_no_failing_line(docs):
    """The quick test in front of the rules for symbols, capitals and words lets through every line that they fail."""
    rules = Q.Rules()
    lines = [line for r in docs.collect() for line in (r["text"] or "").split("\n")]
    lines += ["AB CD EF GH IJ", "A B C D E F G H I J K", "Login", "log in", "sign up", "Ga.", "a | b | c", "ÀÉ ÎÔ ÛÇ ÄÖ Üa", "We use cookies", "Copyright (c) me"]
    for line in lines:
        if Q._WORD.search(line) and not Q._SUSPECT.search(line):
            letters = sum(map(str.isalpha, line))
            assert len(Q._SYMBOL.findall(line)) <= rules.symbol_share * len(line)
            assert letters < 10 or sum(map(str.isupper, line)) <= rules.shouted_share * letters
            assert (Q.has_phrase(line) or not Q._NAVIGATION.search(line) and not Q._BOILERPLATE.search(line)) and len(Q._BAR.findall(line)) < 2


def test_notices_of_four_languages():
    rules = Q.Rules()
    for line in ("All rights reserved.", "Tous droits réservés.", "Politique de confidentialité", "Alle Rechte vorbehalten.", "Todos los derechos reservados", "Weiterlesen", "Leer más", "Lire la suite"):
        assert Q.line_fails(line, rules), line
    for line in ("Wir lesen weiter, bis die Sonne aufgeht.", "El inicio de la historia fue tranquilo.", "The policy of the harbour was private."):
        assert not Q.line_fails(line, rules), line


def test_furniture_is_what_stands_behind_many_lines(spark):
    """A line in many different places is furniture; one in as many copies of a text is not. Against counting in Python."""
    rows = [(i, f"Story {i} began on a day of rain.\nFollow us for daily news\nIt ended {i} days later.") for i in range(30)]
    rows += [(100 + i, "The same old tale is told.\nNobody changes a word of it.") for i in range(60)]
    rows += [(200, None), (201, ""), (202, "\n\n \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    behind = {}
    for _, text in rows:
        lines = [x.strip(" \t\r") for x in (text or "").split("\n")]
        for a, b in zip([None, *lines], lines, strict=False):
            behind.setdefault(b, set()).add(a)
    want = {Q.line_hash(x) for x, places in behind.items() if x and len(places) >= 20}
    assert Q.furniture(docs, Q.Rules()) == want == {Q.line_hash("Follow us for daily news")}
    hashed = spark.createDataFrame([("naïve café — 日本",), ("",), ("a" * 100,)], "s string").selectExpr("s", "xxhash64(s) as h").collect()
    assert all(Q.line_hash(r["s"]) == r["h"] for r in hashed)


def plain_verdict(text, common):
    """The verdict by the rules as they are described, without shortcuts."""
    rules, chars, lost = Q.Rules(), 0, 0
    lower = lambda phrases: [p.lower() for p in phrases]
    for line in text.split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if not words:
            continue
        n, letters, low = len(line), sum(c.isalpha() for c in line), line.lower()
        marks = sum(not (c.isalnum() or c.isspace()) and not re.match(r"[^\W_]", c) for c in line)
        bad = marks >= rules.least_marks and marks > rules.mark_share * n
        bad |= sum(c in "#*$%&|<>" for c in line) > rules.symbol_share * n
        bad |= letters >= 10 and sum(c.isupper() for c in line) > rules.shouted_share * letters
        bad |= len(re.findall(r" [|>»](?= )", line)) >= 2 or any(low.lstrip().startswith(p) and re.match(r"(?:\W.{0,59})?$", low.lstrip()[len(p) :]) for p in lower(Q.NAVIGATION))
        bad |= any(re.search(rf"\b{re.escape(p)}", low) for p in lower(Q.NOTICES))
        bad |= n <= rules.furniture_chars and Q.line_hash(line.strip(" \t\r")) in common
        size = sum(map(len, words))
        chars, lost = chars + size, lost + size * bad
    return lost < rules.lost_share * chars


def test_verdicts_against_plain_rules(docs, edges):
    for df in (docs, edges.where("doc_id < 9 or doc_id > 10 or doc_id is null")):
        common = Q.furniture(df, Q.Rules())
        for r, text in zip(Q.line_first_cleaning(df).select("kept", "base_failed").collect(), (x["text"] or "" for x in df.select("text").collect()), strict=True):
            assert r["kept"] == (not r["base_failed"] and plain_verdict(text, common))


def test_columns_stay(edges):
    out = Q.clean_documents(edges)
    assert out.columns == edges.columns and out.schema["n_chars"].dataType == edges.schema["n_chars"].dataType
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted((r["doc_id"] for r in Q.line_first_cleaning(edges).where("kept").collect()), key=str)
