"""Generated pages whose visible words are known as they are built, and the bounds of lined-up tables."""

import random

from strandline.llm import html_text as H


class Pages:
    """Random trees of elements; words() are what a reader sees, in order."""

    def __init__(self, seed):
        self.r, self.n, self.seen = random.Random(seed), 0, []

    def word(self, shown):
        self.n += 1
        w = f"w{self.n}x"
        if shown:
            self.seen.append(w)
        return w

    def flow(self, depth, shown):
        return " ".join(self.piece(depth, shown) for _ in range(self.r.randint(1, 4)))

    def piece(self, depth, shown):
        kind = self.r.randrange(12) if depth else 0
        inner = lambda s=shown: self.flow(depth - 1, s)
        if kind < 3:
            return self.word(shown)
        if kind == 3:
            return f"<b>{inner()}</b>"
        if kind == 4:
            return f"<div>{inner()}</div>"
        if kind == 5:
            return f"<p>{self.word(shown)}<p>{self.word(shown)}</p>"
        if kind == 6:
            return "<ul>" + "".join(f"<li>{inner()}" + self.r.choice(["", "</li>"]) for _ in range(2)) + "</ul>"
        if kind == 7:
            end = self.r.choice([("", "", ""), ("</td>", "</tr>", "</tbody>")])
            body = "".join("<tr>" + "".join(f"<td{self.r.choice(['', ' colspan=2', ' rowspan=2'])}>{inner()}{end[0]}" for _ in range(self.r.randint(1, 3))) + end[1] for _ in range(self.r.randint(1, 3)))
            return f"<table>{self.r.choice(['', '<tbody>'])}{body}</table>"
        if kind == 8:
            return self.r.choice(["<div hidden>", "<div style='color:red;display:none'>"]) + inner(False) + "</div>"
        if kind == 9:
            return f"<script>var {self.word(False)}</script><!-- {self.word(False)} --><pre>{self.word(shown)}\n {self.word(shown)}</pre>"
        if kind == 10:
            return f"<blockquote>{inner()}</blockquote><br>{self.word(shown)}"
        return f"<textarea>{self.word(shown)}</textarea><select><option>{self.word(shown)}<option>{self.word(shown)}</select>"


def test_every_visible_word_in_order():
    for seed in range(400):
        p = Pages(seed)
        source = "<html><body>" + p.flow(5, True)
        assert [w for w in H.text_of(source).split() if w.startswith("w")] == p.seen, source


def test_visibility_is_inherited_and_undone():
    assert H.text_of("<div style='visibility:hidden'>a<span style='visibility: visible'>b</span><img alt=c></div>d") == "b\n\nd".replace("\n\n", "\n")
    assert H.text_of("<div style='display:none'>a<span style='visibility:visible'>b</span></div>d") == "d"


def test_cells_that_span():
    assert H.text_of("<table><tr><td>aa<td>bb<td>cc<tr><td colspan=2>x<td>y<tr><td rowspan=2>p<td>q<td>r<tr><td>s<td>t</table>") == "aa  bb  cc\nx       y\np   q   r\n    s   t"


def test_tables_are_bounded():
    wide = "<table><tr><td>" + "x" * 40_000 + "<td>y" + "<tr><td>a<td>b" * 5000 + "</table>"
    out = H.text_of(wide)
    assert len(out) < 10 * len(wide) and out.count("b") == 5000 and out.endswith("a  b")
    spans = "<table>" + "<tr><td colspan=1000 rowspan=1000>a<td>b" * 3000 + "</table>"
    assert len(H.text_of(spans)) < 10 * len(spans)
    assert H.text_of("<table><tr><td>k<td>" + "long " * 30 + "<tr><td>kk<td>v</table>").splitlines()[1] == "kk  v"


def test_no_rows(spark):
    assert H.extract(spark.createDataFrame([], "page_id int, html string, text int")).collect() == []
