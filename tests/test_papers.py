import pytest

from quire.plans import papers

MAIN = r"""\documentclass{a}
\begin{document}
\begin{abstract} One $x + y$ two \emph{three}. \end{abstract}
\section{One} \tag{1.2} \tag{2.1} \tag{V.1}
% \input{never}
\input{sub/body}
\section{Last} \tag{(3.1)} See Thm. 4 alone.
\end{document}
"""
BODY = r"""\newtheorem{claim}{Claim}
\theoremstyle{remark}\newtheorem{note}{Note}
\section{Two} \tag{2.4} \include{deep.tex}\section*{Funding}
\begin{theorem}\label{thm:a}\begin{enumerate}\item a\item b\end{enumerate}\end{theorem}
By \ref{thm:a}(2), \cref{thm:a}~(iii) and \ref{thm:z}(9). In \S 5 of \cite{x} it stands.
% no blueprint node: too small
\begin{claim}\label{c:one} x \end{claim}
\begin{note} y \end{note}
% shared with blueprint lem:s
\begin{lemma} z \begin{claim} nested \end{claim} \end{lemma}
"""
DEEP = "\\appendix \\section{A} \\tag{A.1} \\tag{B.1}\n\\input{main}"


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([("main.tex", MAIN), ("sub/body.tex", BODY), ("sub/deep.tex", DEEP), ("none.tex", None)], "path string, text string")


def test_expansion(spark, texts):
    roots = spark.createDataFrame([("main.tex",)], "node string")
    got = {r.path: r.text for r in papers.expanded(texts, roots).collect()}
    want = MAIN.replace("\\input{sub/body}", BODY.replace("\\include{deep.tex}", DEEP.replace("\\input{main}", "")))
    assert got == {"main.tex": want}
    order = papers.first_reached(papers.reading_order(texts, roots)).orderBy("place").collect()
    assert [r.path for r in order] == ["main.tex", "sub/body.tex", "sub/deep.tex"]


def test_long_chain(spark):
    chain = spark.createDataFrame([(f"f{k}", f"a{k}\\input{{f{k + 1}}}") for k in range(70)] + [("f70", "end")], "path string, text string")
    got = papers.expanded(chain, spark.createDataFrame([("f0",)], "node string")).first().text
    assert got == "".join(f"a{k}" for k in range(70)) + "end"


def test_lint(spark, texts):
    modules = spark.createDataFrame([("main.tex", "m"), ("sub/body.tex", "m"), ("sub/deep.tex", "m"), ("none.tex", None)], "path string, module string")
    got = sorted((r.tag, r.subject, r.detail) for r in papers.lint(texts, modules, spark.createDataFrame([("main.tex",)], "node string")).collect())
    assert got == [
        ("abstr", "m", "4 words"), ("decl", "m", "author contributions"), ("decl", "m", "competing interests"), ("decl", "m", "data availability"),
        ("item", "sub/body.tex:5", "thm:a has 2 items, not 3"), ("point", "main.tex:7", "Thm."), ("tag", "main.tex:4", "2.1 stands in 1"), ("tag", "sub/deep.tex:1", "B.1 stands in A"),
    ]


def test_unmarked(texts):
    assert sorted(r.env for r in papers.declared_environments(texts, ("theorem", "lemma")).collect()) == ["claim", "lemma", "theorem"]
    got = [tuple(r) for r in papers.unmarked(texts, papers.declared_environments(texts)).collect()]
    assert got == [("sub/body.tex", 4, "theorem", "thm:a")]


def test_numbers():
    assert [papers.item_number(x) for x in ("3", "iv", "X", "iix", "vx", "ix")] == [3, 4, 10, 0, 0, 9]
    assert papers.abstract_words("a $b c$ {d} \\emph{e} --- f") == 5
    assert papers.blanked("a \\% b % c\nd") == "a \\% b    \nd"
