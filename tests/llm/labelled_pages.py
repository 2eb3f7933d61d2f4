"""Pages from which the labelled blocks of the extractor are cut: each block begins with + (text of the article) or - (not)."""

from __future__ import annotations


def words(mark: str, n: int) -> str:
    return mark + " ".join(["word"] * n)


def link(mark: str, n: int) -> str:
    return f"<a href=x>{words(mark, n)}</a>"


def some(tag: str, mark: str, *sizes: int) -> str:
    return "".join(f"<{tag}>{words(mark, n)}</{tag}>" for n in sizes)


def links(tag: str, mark: str, *sizes: int) -> str:
    return "".join(f"<{tag}>{link(mark, n)}</{tag}>" for n in sizes)


PAGES = [
    # an article between everything that is named as no part of it
    f"<header>{link('-', 1)} our site</header><nav><ul>{links('li', '-', 1, 2, 1)}</ul></nav><div class=cookie-notice>{words('-', 30)}</div>"
    f"<article><h1>{words('+', 5)}</h1>{some('p', '+', 60, 3)}<div class=ad>{words('-', 12)}</div>{some('p', '+', 25, 8)}<aside>{words('-', 45)}</aside>"
    f"{some('p', '+', 1, 140)}</article><div id=comments>{some('p', '-', 4, 90)}</div><footer>{words('-', 6)}</footer>",
    # links inside an article: a paragraph, a list, a heading, parts of paragraphs; and a bare row of them, which leads elsewhere
    f"<article><h2>{link('+', 4)}</h2><p>{link('+', 10)}</p><p>{words('+', 12)} {link('', 9)}</p><h3>{words('+', 1)}</h3>"
    f"<ol>{links('li', '+', 5, 9, 7, 1)}</ol><p>{words('+', 6)}</p><p>{words('+', 3)} {link('', 14)}</p><blockquote>{link('+', 20)}</blockquote>"
    f"<div>{link('-', 1)} {link('', 2)}</div><div>{link('-', 6)}</div></article><div class=related>{link('-', 7)}</div>",
    f"<article><h2>{words('+', 1)}</h2><ol><li>{link('+', 4)}</li><li>{link('+', 1)}{words(' ', 1)}</li><li>{link('+', 3)} {words('', 2)}</li><li>{link('+', 2)}</li></ol></article>",
    f"<article><p>{words('+', 30)}</p><p>{link('+', 5)} {words('', 5)}</p><ul><li>{link('+', 6)} {words('', 1)}</ul></article>",
    f"<article>{some('p', '+', 3)}<div>{link('-', 1)} {link('', 1)}</div></article>", f"<article>{some('p', '+', 20, 9)}<div>{link('-', 3)}</div></article>",
    f"<article><div>{link('-', 2)}</div>{some('p', '+', 50)}<div>{link('-', 1)}</div></article>",
    f"<article>{some('p', '+', 40)}<p>{link('+', 12)}</p>{some('p', '+', 60)}<p>{words('+', 6)} {link('', 9)}</p>{some('p', '+', 30)}<p>{words('+', 10)} {link('', 20)}</p>"
    f"<p>{link('+', 2)}</p>{some('p', '+', 5)}<p>{words('+', 4)} {link('', 5)}</p>{some('p', '+', 90)}<ul>{links('li', '+', 14, 3)}</ul>{some('p', '+', 7)}</article>",
    f"<article>{some('p', '+', 60)}<p>{words('+', 5)} {link('', 9)}</p>{some('p', '+', 70)}<p>{words('+', 6)} {link('', 5)}</p>{some('p', '+', 55)}<p>{words('+', 3)} {link('', 8)}</p>"
    f"{some('p', '+', 80)}<p>{words('+', 10)} {link('', 17)}</p>{some('p', '+', 3)}</article>",
    f"<article>{some('div', '+', 30)}<div>{words('+', 5)} {link('', 9)}</div>{some('div', '+', 44)}<div>{words('+', 12)} {link('', 11)}</div></article>",
    f"<article>{some('p', '+', 25)}<div class=promo>{some('p', '-', 30)}{links('p', '-', 4, 10)}<div>{link('-', 2)}</div></div>{some('p', '+', 33)}<ul class=menu>{links('li', '-', 2, 1)}</ul></article>",
    f"{some('div', '+', 45, 60)}<div>{words('-', 5)} {link('', 9)}</div><div>{words('-', 2)} {link('', 3)}</div>{links('div', '-', 2)}",
    f"{some('p', '+', 45, 60)}<p>{words('-', 3)} {link('', 8)}</p><p>{words('-', 1)} {link('', 5)}</p>{links('p', '-', 2)}",
    # short articles, and one of a single line
    f"<article><h1>{words('+', 2)}</h1>{some('p', '+', 4, 2, 1)}</article>", f"<main>{words('+', 3)}</main><div>{link('-', 3)}</div>",
    f"<div>{link('-', 2)}</div><article>{some('p', '+', 18)}</article><div>{link('-', 1)}</div>", f"<article><ul>{some('li', '+', 1, 1, 2)}</ul><div>{words('+', 9)}</div></article>",
    f"<article><div>{words('+', 50)}</div><div>{words('+', 7)} {link('', 2)}</div><table><tr><td>{words('+', 2)}</td><td>{link('+', 1)}</td></tr></table></article>",
    # long asides inside and outside
    f"<article>{some('p', '+', 35)}<div class=sidebar>{some('p', '-', 70, 20)}{links('p', '-', 8)}</div>{some('p', '+', 40)}</article><form>{words('-', 25)}</form>",
    # nothing named: rows of links, long blocks, short ones between them, and lines among links
    f"<div>{words('-', 2)}</div>{links('div', '-', 1, 1, 2)}<h1>{words('+', 6)}</h1>{some('p', '+', 45, 30, 9, 60)}{links('div', '-', 2, 3)}<div>{words('-', 7)}</div>{links('div', '-', 1)}",
    f"<div>{words('-', 3)}</div><ul>{links('li', '-', 1, 2, 1, 4)}</ul><div>{words('+', 80)}</div><div>{words('+', 22)} {link('', 5)}</div><div>{words('+', 55)}</div>"
    f"<h3>{words('-', 2)}</h3><ul>{links('li', '-', 6, 8, 5, 11)}</ul><div>{words('-', 9)}</div>{links('div', '-', 1)}",
    f"{links('td', '-', 1, 3)}<td>{words('+', 150)}</td>{links('td', '-', 2)}<td>{words('-', 4)}</td>{links('td', '-', 1, 12)}",
    f"{links('p', '-', 3, 25)}<h2>{words('+', 4)}</h2>{some('p', '+', 35, 14, 40, 5, 70)}<p>{link('-', 9)}</p><p>{words('-', 6)} {link('', 5)}</p>",
    f"{links('div', '-', 4)}<div>{words('+', 25)}</div><div>{words('+', 20)}</div>{links('div', '-', 2)}<div>{words('-', 10)}</div>{links('div', '-', 3)}",
    # no markup to speak of
    words("+", 7), words("+", 1), words("+", 3), words("+", 40), f"<body>{words('+', 12)}</body>", some("p", "+", 5, 6), some("p", "+", 2, 3, 4), some("div", "+", 16, 11),
    link("-", 2), links("p", "-", 3, 4), links("li", "-", 1, 1),
]


def rows() -> list[tuple]:
    """The distinct blocks of all pages: their features and 1 for text of the article."""
    from palletwatch.llm.html_blocks import blocks
    from palletwatch.llm.html_extract import describe

    out = {}
    for page in PAGES:
        found = blocks(page)
        for block, features in zip(found, describe(found), strict=True):
            assert block.text[0] in "+-", block
            out[*(round(float(x), 2) if i in (1, 3, 5) else int(x) for i, x in enumerate(features)), int(block.text[0] == "+")] = None
    return list(out)
