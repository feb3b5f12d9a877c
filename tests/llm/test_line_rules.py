import re
from collections import Counter, defaultdict

from llm.prose import lines, prose
from runledger.llm.line_rules import clean_documents, line_verdicts, op9_line_rules, repeat_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_are_those_of_a_plain_reading(spark, texts):
    found = op9_line_rules(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(texts)
    for r in found:
        expected = counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (r["base_failed"] and r["kept"])


def test_repeated_windows():
    assert repeat_words("a b c a b c".encode().split()) == 6
    assert repeat_words("a a a a".encode().split()) == 4
    assert repeat_words("a b c d".encode().split()) == 0
    assert repeat_words([]) == 0


def test_shared_lines_go_and_depleted_documents_with_them(make):
    notice, banner = "Every  Page of this HOST says this very line of words", lines(prose(99, 60), 60)
    rows = [(i, lines(prose(i, 80)) + "\n" + notice, "h") for i in range(40)]
    rows += [(100 + i, banner + "\n" + " ".join(prose(500 + i, 8)), "h") for i in range(30)]  # little of their own
    rows += [(200 + i, lines(prose(900 + i, 80)) + "\n" + notice.lower(), "other") for i in range(3)]  # below the limit there
    found = {r["doc_id"]: r for r in line_verdicts(make(rows)).collect()}
    assert all(found[i]["kept"] and found[i]["lost_words"] == 11 for i in range(40))
    assert all(not found[100 + i]["kept"] and not found[100 + i]["base_failed"] for i in range(30))
    assert all(found[200 + i]["kept"] and found[200 + i]["lost_words"] == 0 for i in range(3))
    cleaned = {r["doc_id"]: r for r in clean_documents(make(rows)).collect()}
    assert set(cleaned) == {*range(40), 200, 201, 202}
    assert cleaned[3]["text"] == lines(prose(3, 80)) and cleaned[3]["n_chars"] == len(cleaned[3]["text"])
    assert cleaned[200]["text"] == rows[-3][1] and cleaned[200]["host"] == "own"


def test_copies_do_not_turn_prose_into_boilerplate(make):
    words = prose(7, 120)
    rows = [(i, lines(words), "h") for i in range(40)]
    for i in range(40, 90):
        edited = list(words)
        edited[i] = f"new{i}"
        rows.append((i, lines(edited), "h"))
    assert all(r["kept"] and r["lost_words"] == 0 for r in line_verdicts(make(rows)).collect())


def test_many_shared_lines_do_not_protect_each_other(make):
    """Ten lines of 12 words in 300 documents with 30 words of their own: four fifths of each goes."""
    shared = lines(prose(77, 120), 12)
    rows = [(i, shared + "\n" + lines(prose(2000 + i, 30), 10), "h") for i in range(300)]
    rows += [(1000 + i, lines(prose(4000 + i, 90)), "h") for i in range(50)]
    found = {r["doc_id"]: r for r in line_verdicts(make(rows)).collect()}
    assert all(found[i]["lost_words"] == 120 and not found[i]["kept"] for i in range(300))
    assert all(found[1000 + i]["lost_words"] == 0 and found[1000 + i]["kept"] for i in range(50))


def test_copies_of_one_holder_do_not_protect_a_line(make):
    """One line in 60 documents is boilerplate, whatever the number of copies of one of them."""
    line = " ".join(prose(55, 9))
    rows = [(i, lines(prose(3000 + i, 70)) + "\n" + line, "h") for i in range(60)]
    rows += [(100 + i, rows[0][1], "h") for i in range(700)]
    edited = rows[1][1].split()
    rows += [(900 + i, lines([*edited[:i], f"edit{i}", *edited[i + 1 : 70]]) + "\n" + line, "h") for i in range(60)]  # near copies
    found = line_verdicts(make(rows)).collect()
    assert len(found) == 820 and {r["lost_words"] for r in found} == {9} and all(r["kept"] for r in found)


def test_near_copies_alone_are_no_boilerplate(make):
    words = prose(8, 300)
    rows = []
    for i in range(200):
        edited = list(words)
        for k in range(5):  # five words of three hundred
            edited[(i * 37 + k * 61) % 300] = f"edit{i}x{k}"
        rows.append((i, lines(edited), "h"))
    assert all(r["kept"] and r["lost_words"] == 0 for r in line_verdicts(make(rows)).collect())


def test_verdicts_of_a_table_agree_with_a_brute_force_count(make):
    shared = [" ".join(prose(1000 + k, 7)) for k in range(6)]
    rows = [(i, "\n".join([lines(prose(i, 70)), *[s for k, s in enumerate(shared) if i % (k + 1) == 0]]), f"h{i % 2}") for i in range(60)]
    holders = defaultdict(set)
    for i, text, host in rows:
        for line in text.split("\n"):
            holders[host, line].add(i)
    for r in line_verdicts(make(rows)).collect():
        text, host = rows[r["doc_id"]][1:]
        assert r["lost_words"] == sum(len(x.split()) for x in text.split("\n") if len(holders[host, x]) > 10)


def test_odd_rows(make, spark):
    long = lines(prose(3, 60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, lines(prose(1, 60))), (4, long), (5, lines(prose(5, 60)), None), (5, lines(prose(5, 60)), None)]
    found = line_verdicts(make(rows)).collect()
    assert len(found) == 7
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[i]["base_failed"] and by_id[i]["n_words"] == 0 for i in (1, 2, 3))
    assert by_id[None]["kept"] and by_id[5]["kept"] and by_id[4]["n_words"] == 60_000
    assert clean_documents(make(rows)).count() == 4
    assert line_verdicts(make([])).collect() == [] and clean_documents(make([])).collect() == []
