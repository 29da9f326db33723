"""Text expressions against plain Python on awkward rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dossier.functions import gates, prompts, records, scores, text

ROWS = [
    "",
    "   \n\t ",
    "Jane Doe\njane.doe+cv@mail.example.com other@x.org",
    "\n\n  Ann-Marie O'Neil  \nno mail here",
    "X\nname too short a@b.co",
    "a" * 50,
    "a" * 51,
    "name with digit 7\nfoo@bar",
    "carriage\r\nreturn\rnew",
    "bell \x07 and c1 \x85 and emoji \U0001F600 end",
    "accents é ü   wide　space line",
    "\x1cfile\x1dgroup\x1erecord\x1funit",
    "a  b\t\tc\n\n\n\nd\n\n\ne",
    "-----\n====\n***\n..\nkept line\n  ___  \n",
    " Only Spaces \nsecond",
    "tail newline\n",
    "one\x0btwo\x0cthree",
]
NAMES = {2: "Jane Doe", 3: "Ann-Marie O'Neil", 5: "a" * 50, 8: "carriage", 11: "file", 13: "-----", 14: "Only Spaces", 15: "tail newline", 16: "one"}
EMAILS = {2: "jane.doe+cv@mail.example.com", 4: "a@b.co"}
CLEANED = [
    "",
    "",
    "Jane Doe\njane.doe+cv@mail.example.com other@x.org",
    "Ann-Marie O'Neil \nno mail here",
    "X\nname too short a@b.co",
    "a" * 50,
    "a" * 51,
    "name with digit 7\nfoo@bar",
    "carriage \nreturn new",
    "bell and c1 and emoji end",
    "accents é ü \xa0 wide\u3000space\u2028line",
    "file group record unit",
    "a b c\n\nd\n\ne",
    "-----\n====\n***\n..\nkept line\n ___",
    "Only Spaces\u2003\nsecond",
    "tail newline",
    "one two three",
]
BODIES = [
    "",
    "",
    "Jane Doe\njane.doe+cv@mail.example.com other@x.org",
    "Ann-Marie O'Neil\nno mail here",
    "X\nname too short a@b.co",
    "a" * 50,
    "a" * 51,
    "name with digit 7\nfoo@bar",
    "carriage\nreturn\nnew",
    "bell \x07 and c1\nand emoji \U0001F600 end",
    "accents é ü \xa0 wide\u3000space\nline",
    "file\ngroup\nrecord\x1funit",
    "a  b\t\tc\nd\ne",
    "..\nkept line",
    "Only Spaces\nsecond",
    "tail newline",
    "one\ntwo\nthree",
]


def evaluate(spark, values, make, type_name="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_name}")
    return [r["out"] for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_metadata(spark):
    assert evaluate(spark, ROWS, text.leading_name) == [NAMES.get(i, "Unknown") for i in range(len(ROWS))]
    assert evaluate(spark, ROWS, text.first_email) == [EMAILS.get(i, "N/A") for i in range(len(ROWS))]


def test_cleaning(spark):
    assert evaluate(spark, ROWS, text.clean_for_embedding) == CLEANED
    assert evaluate(spark, ROWS, text.embeddable) == [v or None for v in CLEANED]
    assert evaluate(spark, [None], text.embeddable) == [None]
    assert evaluate(spark, ROWS, text.words) == [v.split() for v in ROWS]
    assert evaluate(spark, ROWS, text.lines) == [[l.strip() for l in v.splitlines() if l.strip()] for v in ROWS]


@pytest.mark.parametrize("count, expected", [(5999, "\n w" * 5999), (6000, "\n w" * 6000), (6001, " w" * 6000)])
def test_word_limit(spark, count, expected):
    assert evaluate(spark, ["  w\n" * count], text.clean_for_embedding) == [expected.strip()]
    short = "ab  c d\n" * 500
    assert evaluate(spark, [short], lambda c: text.first_words(c, 1500)) == [short]
    assert evaluate(spark, [short], lambda c: text.first_words(c, 1499)) == [" ".join(short.split()[:1499])]


def test_searchable_chunk(spark):
    out = evaluate(spark, ROWS, lambda c: text.searchable_text(c, F.lit("N"), F.lit("e@x.io")))
    assert out == [f"Candidate: N\nEmail: e@x.io\n\n{body}" for body in BODIES]
    long = evaluate(spark, ["word\n---\n" * 1300], lambda c: text.searchable_text(c, F.lit("N"), F.lit("e")))
    assert long == ["Candidate: N\nEmail: e\n\n" + " ".join(["word"] * 1200)]
    assert evaluate(spark, ["t"], lambda c: text.searchable_text(c, F.lit(None), F.lit(None))) == [
        "Candidate: Unknown\nEmail: N/A\n\nt"
    ]


def test_small_projections(spark):
    assert evaluate(spark, ["N/A"], lambda c: text.record_key(c, F.lit("my cv (1).docx"))) == ["N_A__my_cv__1_.docx"]
    assert evaluate(spark, ["factual_agent", "error"], text.agent_label) == ["Factual Agent", "Error"]
    assert evaluate(spark, ["/a/b/report.v2.PDF", "x", "/d.x/.hidden"], text.file_stem) == ["report.v2", "x", ".hidden"]
    assert evaluate(spark, ["/a/b.JSON", "/d.x/none", "/.hidden"], text.file_suffix) == [".json", "", ""]
    assert evaluate(spark, [None], lambda c: text.upload_date(c.cast("timestamp"))) == ["N/A"]


def test_output_kind(spark):
    values = [" Traceback (most", "an Error here", "text\n  def f():", "# note", "define", "print(1)", "", "classy"]
    assert evaluate(spark, values, text.output_kind) == [
        "error", "error", "code", "code", "markdown", "code", "markdown", "markdown",
    ]
    assert evaluate(spark, ["  define", "x = 1", "\nwhile", "#"], text.looks_like_code) == [True, False, True, True]


def test_intents(spark):
    said = ["More resumes please", "RESET", "show more resumes", "db stats", "show db stats", "hm", "ranking"]
    assert evaluate(spark, said, text.matcher_intent) == [
        "more", "restart", "more", "stats", "results", "other", "results",
    ]
    asked = ["set results 7", "only matched, show all", "Show ALL", "DB stats", "python developer"]
    assert evaluate(spark, asked, text.search_intent) == ["set_results", "only_matched", "show_all", "stats", "query"]
    wanted = ["set results 7", "set results 0", "SET RESULTS 99999999999999", "set results x", "set results 2.5",
              "set results -3", "results 5", "set results"]
    assert evaluate(spark, wanted, text.requested_results) == [7, 1, 20, None, None, 1, None, None]


def test_keywords(spark):
    asked = ["Find a Hadoop developer", "show me the people", "AI ml", "C++ and data_lake"]
    assert evaluate(spark, asked, text.query_keywords) == [["hadoop", "developer"], [], [], ["data_lake"]]


def test_topic_gate(spark):
    said = [
        "How do I sort a list in Python?",
        "write java code",
        "javascript loop",
        "decorator in python",
        "learn r now",
        "c++ class",
        "c++11 class",
        "go fast",
        "ValueError",
        "xyz",
        "bring é",
    ]
    assert evaluate(spark, said, gates.topic_gate) == [
        True, False, False, True, False, True, False, False, True, False, True,
    ]
    assert evaluate(spark, ["a string", "ValueError raised", "None"], lambda c: gates.topic_gate(c, mode="word")) == [
        False, True, True,
    ]


def test_greeting_and_classes(spark):
    assert evaluate(spark, ["Hi ", "hi there", " Thank You", "hey"], gates.is_greeting) == [True, False, True, True]
    asked = [
        "What is the definition of risk management?",
        "Compare the risk assessment approaches mentioned in the document",
        "What are the main differences between verification and validation?",
        "Explain the complete software lifecycle process and how risk management integrates at each stage",
        "What steps should I follow to implement a risk management system?",
    ]
    assert evaluate(spark, asked, gates.cue_class) == ["factual", "analytical", "analytical", "complex", "complex"]
    assert evaluate(spark, ["factual", "weird", "complex"], gates.agent_route) == [
        "factual_agent", "factual_agent", "complex_agent",
    ]
    assert evaluate(spark, ["factual", "analytical", "complex", "weird"], gates.passages_wanted) == [4, 6, 8, 8]
    assert evaluate(spark, [" YES.", "no", None, "yesterday"], gates.says_yes) == [True, False, False, True]


def test_labels_and_methods(spark):
    assert evaluate(spark, [0.85, 0.8499, 0.7, 0.6999], scores.fit_label, "double") == ["Strong", "Good", "Good", "Weak"]
    rows = spark.createDataFrame([(8, 16, 0.1), (8, 16, 0.0), (None, 16, 0.1), (0, 1, 0.1)], "r int, a int, d double")
    out = rows.select(scores.training_method(F.col("r"), F.col("a"), F.col("d")).alias("m")).collect()
    assert [r["m"] for r in out] == ["lora", "traditional", "traditional", "traditional"]


def test_vectors(spark):
    rows = spark.createDataFrame(
        [([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([1.0, 2.0], [-1.0, -2.0]), ([0.0, 0.0], [1.0, 1.0])],
        "a array<float>, b array<float>",
    )
    a, b = F.col("a"), F.col("b")
    out = rows.select(F.round(scores.cosine(a, b), 9).alias("c"), F.round(scores.euclidean(a, b), 6).alias("e")).collect()
    assert [r["c"] for r in out] == [0.0, 1.0, -1.0, 0.0]
    assert [r["e"] for r in out] == [round(5**0.5, 6), round(2**0.5, 6), round(20**0.5, 6), round(2**0.5, 6)]


def test_prompts(spark):
    full = "<|system|>\nx<|end|>\n<|assistant|>\nfirst<|assistant|>\nlast"
    assert evaluate(spark, [full, "no tag"], prompts.assistant_answer) == ["last", "no tag"]
    assert evaluate(spark, ["x" * 150], prompts.summary_input) == ["Process: " + "x" * 100]
    prompt = evaluate(spark, ["ctx $1 \\ {query}"], lambda c: prompts.agent_system_text(F.lit("factual_agent"), c))[0]
    assert "ctx $1 \\ {query}" in prompt and "{context}" not in prompt
    payload = spark.createDataFrame(
        [(None, [("user", "a"), ("user", "b")], None), ("in", None, "t"), (None, [], None), (None, None, "t")],
        "input string, messages array<struct<role:string,content:string>>, text string",
    )
    out = payload.select(prompts.prompt_text(F.struct("input", "messages", "text")).alias("p")).collect()
    assert [r["p"] for r in out] == ["b", "in", "", "t"]


def test_flatten(spark):
    values = [
        '{"a":"x","b":0,"c":"0","d":true,"e":false,"f":null,"g":[],"h":{},"i":1.5,"j":"","k":{"z":1}}',
        "{}",
        '{"b":"2","a":"1"}',
    ]
    assert evaluate(spark, values, records.flatten_json) == [
        'a: x c: 0 d: True i: 1.5 k: {"z":1}', "", "b: 2 a: 1",
    ]
    shapes = [
        '[{"k":1,"z":0},"s",3,null,true]', '{"x":{"b":1},"y":{"c":2}}', '{"x":{"b":1},"y":3}', "5", '"hey"', "{}", "[]",
        "null", "true",
    ]
    assert evaluate(spark, shapes, records.json_texts) == [
        ["k: 1", "s", "3", "None", "True"], ["b: 1", "c: 2"], ['x: {"b":1} y: 3'], ["5"], ["hey"], [], [], ["None"],
        ["True"],
    ]
