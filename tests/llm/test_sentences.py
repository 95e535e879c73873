import pytest

from tapeline.llm import sentences

# "|" stands after each sentence's last character
CASES = [
    "One.| Two?!| Three.|",
    "See Fig. 2 and Eq.~(3), cf. Dr. Smith et al. (2020).| $x=3.14$ holds, e.g. here.|",
    "It has 3 in App. B.| $\\beta$-mixing holds.|",
    "J. W. Corvath agrees.| The U.S. sample is small... or so it seems.|",
    "Lists, sets, etc.| Next one, etc. and on.|",
    "The statement ``It is so. It holds.'' was withdrawn.| He called it ``sharp.''| Then.|",
    "(This holds.)| And this (cf. Fig. 2).|",
    "We obtain\n$$x = 1.5, \\qquad y.|$$\nThen\n\\begin{equation}\nz = 2,\n\\end{equation}\nwhere $z$.|",
    "\\section{A title. Two}\n\\label{a.b}\nText % a comment. Two.\ngoes on.|\n\n\\iffalse\nGone. Gone.\n\\fi\n\nA paragraph without a mark|\n\nEnd.|",
    "The following hold:|\n\\begin{itemize}\n\\item first thing|\n\\item Second thing.|\n\\end{itemize}\nAfter.|",
    "\\begin{figure}\n\\caption{Not this. Nor this.}\n\\end{figure}\nBut this.\\footnote{Not. This.}|",
    "Data at \\url{https://a.b/c.d} here \\cite{x.y}.|",
    "平均値は7.64である。|なぜ有限なのか?|「短い。少ない。」と述べた。|状態を$x$とおく.|詳細。|",
    "作者写道:“队列很短。样本也少。”但没有证明。|共有3天……其余被删除。|",
    "डॉ. Tesk ने कहा, “छोटी है। सरल है।” और आगे।| क्या यह 1.5 है?|",
    "هل يصح هذا؟| يرى د. Tesk ذلك.|",
    "ราคาเวลาสถานะ| ตลาดราคา8.8มี| การทดลอง|",
    "Am 3. Mai kam z. B. Dr. Tesk, vgl. S. 5.| Im 2. Kapitel, s. o., folgt er.|",
    "M. Tesk écrit : « La borne est fine. Elle suffit. » sans preuve.| Pourquoi ?| Quelle surprise !|",
    "¿Es cierto?| La muestra de EE. UU. es p. ej. breve.|",
    "В 2049 г. было 1 тыс. записей, т. е. много, у А. Б. Тесковой.| См. рис. 2.|",
    "Windows\r\nline.|\r\n\r\nNext one|\r\n\r\n",
]


def ends(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: list(r.ends) for r in sentences.sentence_ends(df).collect()}


@pytest.fixture(scope="module")
def marked(spark):
    return ends(spark, [c.replace("|", "") for c in CASES])


@pytest.mark.parametrize("i", range(len(CASES)))
def test_ends(marked, i):
    want, at = [], -1
    for c in CASES[i]:
        if c == "|":
            want.append(at)
        else:
            at += 1
    text = CASES[i].replace("|", "")
    assert [text[: e + 1][-12:] for e in marked[i]] == [text[: e + 1][-12:] for e in want]


def test_places_count_from_the_whole_text(spark):
    text = "\\title{No. No.}\n\\begin{document}\n\\maketitle\n🙂 Yes.\n\\end{document}\nNo. No."
    assert ends(spark, [text]) == {0: [text.index("Yes.") + 3]}


def test_a_commented_begin_is_no_begin(spark):
    text = "% \\begin{document} old\n\\iffalse \\begin{document} \\fi\n\\title{No. No.} 5\\% No. \\begin{document}\nYes.\n\\end{document}"
    drafts = "% \\begin{document}\nAll of it. Is text.\n"
    assert ends(spark, [text, drafts]) == {0: [text.index("Yes.") + 3], 1: [drafts.index("it.") + 2, drafts.index("text.") + 4]}


def test_null_empty_blank_cut_and_odd_texts(spark):
    texts = [None, "", " \n\t ", "\\begin{document}", "cut $x_", "\ue000\ue004 odd.", "word " * 20_000, "a. " * 3_000, "A bc. " * 3_000]
    out = ends(spark, texts)
    assert 0 not in out and out[1] == out[2] == out[3] == []
    assert out[4] == [6] and out[5] == [len(texts[5]) - 1] and out[6] == [len(texts[6]) - 2]
    assert len(out[8]) == 3_000
    assert ends(spark, []) == {}


def test_a_text_of_very_many_sentences(spark):
    text = "A bc. D.\n\n" * 20_000
    want = [10 * k + e for k in range(20_000) for e in (4, 7)]
    assert ends(spark, [text])[0] == want


def test_sentences_are_the_text_between(spark):
    text = "\\section{T}\nOne.  Two $x$.\n"
    rows = sentences.sentences(spark.createDataFrame([(5, text, 1)], "doc_id long, text string, number int")).orderBy("number").collect()
    assert [(r.number, r.sentence) for r in rows] == [(0, "One."), (1, "Two $x$.")]
    assert all(text[r.start_pos : r.end_pos + 1] == r.sentence for r in rows)
