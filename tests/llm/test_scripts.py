"""Language identification where letters are many: several scripts, thousands of characters."""

import random

from textgrove.llm import language_id

# first and last letter of a script, letters used of it
SCRIPTS = {"en": (97, 26), "he": (0x5D0, 27), "ja": (0x3041, 83), "ka": (0x10D0, 33), "ko": (0xAC00, 3000), "zh": (0x4E00, 4000), "zy": (0x4E00, 4000)}


def lexicons():
    draw = random.Random(5)
    return {
        name: ["".join(chr(low + draw.randrange(n)) for _ in range(draw.randrange(2, 5))) for _ in range(800)]
        for name, (low, n) in SCRIPTS.items()
    }


def plain(text, sample):
    phrases, i = 0, 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in sample:
            n += 1
        phrases, i = phrases + 1, i + n
    return phrases


def test_many_letters_against_substrings():
    draw, words = random.Random(6), lexicons()
    samples = {name: [" ".join(draw.choices(w, k=400))] for name, w in words.items()}
    parser = language_id.CrossParser(samples)
    parser.prepare()
    texts = [" ".join(draw.choices(w, k=30)) for w in words.values()]
    texts += [" ".join(draw.choices(sum(words.values(), []), k=60)), "กข abc 一鿿"]
    rates, lettered = parser.phrases(texts)
    assert lettered.all()
    for text, row in zip(texts, rates):
        assert row.tolist() == [plain(text, samples[name][0]) / len(text) for name in parser.languages]


def test_every_script_is_told_apart(spark):
    draw, words = random.Random(7), lexicons()
    rows = [
        (len(SCRIPTS) * i + k, " ".join(draw.choices(w, k=60)), name)
        for k, (name, w) in enumerate(words.items())
        for i in range(60)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    named = {d: name for d, _, name in rows}
    found = [r for r in language_id.identify(docs).collect() if r.held_out]
    assert len(found) > 50 and all(r.lang_pred == named[r.doc_id] for r in found)
