"""Pages with known main text, for fitting and testing the extraction: articles of many layouts among menus, adverts, notices,
forms, sidebars, comments and footers, with class names and semantic elements that may be missing."""

import random


def _sentence(rnd, least=4, most=18):
    words = ["".join(rnd.choices("aeinorstlu", k=rnd.randint(2, 9))) for _ in range(rnd.randint(least, most))]
    return " ".join(words).capitalize() + rnd.choice("....?!")


def _prose(rnd):
    return " ".join(_sentence(rnd) for _ in range(rnd.choice([1, 1, 2, 3, 5, 8])))


def _label(rnd):
    return " ".join("".join(rnd.choices("aeinorstlu", k=rnd.randint(2, 8))) for _ in range(rnd.randint(1, 3))).capitalize()


def _link(rnd, text):
    return f'<a href="/{rnd.randint(1, 999)}">{text}</a>'


def page(rnd, bare=0.2):
    """A page and its blocks' texts with the label True for main text; a share ``bare`` of pages has no telling names."""
    plain = rnd.random() < bare
    card = "div" if plain else "article"
    blocks = []

    def say(text, good):
        blocks.append((" ".join(text.split()), good))
        return text

    def element(tags, names, inner):
        tag, name = rnd.choice(tags), rnd.choice(names)
        if tag not in ("div", "section") and rnd.random() < 0.5:
            name = ""
        if plain:
            tag, name = "div", rnd.choice(["", "", "x1", "wrap", "c-7"])
        attribute = f' {rnd.choice(["class", "id"])}="{name}"' if name else ""
        return f"<{tag}{attribute}>{inner()}</{tag}>"

    def links(good=False):
        return "<ul>" + "".join(f"<li>{_link(rnd, say(_label(rnd), good))}</li>" for _ in range(rnd.randint(2, 7))) + "</ul>"

    def boiler():
        kind = rnd.randrange(8)
        p = lambda text: f"<p>{say(text, False)}</p>"
        if kind == 0:
            return element(["nav", "div", "div"], ["nav", "main-menu", "navbar", "breadcrumbs"], links)
        if kind == 1:
            return element(["div", "aside"], ["ad", "ad-slot", "sponsored", "advert box"], lambda: say(_sentence(rnd), False) if rnd.random() < 0.5 else p(_sentence(rnd)))
        if kind == 2:
            return element(["div", "section"], ["cookie-notice", "notice", "gdpr-banner", "alert"], lambda: p(_sentence(rnd)))
        if kind == 3:
            return element(["aside", "div"], ["sidebar", "widget", "related", "right-rail"], lambda: f"<h3>{say(_label(rnd), False)}</h3>" + links())
        if kind == 4:
            return element(["form", "div"], ["newsletter", "signup-form", "login"], lambda: f"<label>{_label_of(False)}</label><input><button>Go</button>")
        if kind == 5:
            return element(["section", "div"], ["comments", "comment-list", "replies"], lambda: "".join(f"<{card}><p>{say(_sentence(rnd), False)}</p></{card}>" for _ in range(rnd.randint(1, 3))))
        if kind == 6:
            return element(["div"], ["share-links", "social", "tags"], links)
        return element(["div", "aside"], ["promo", "teaser"], lambda: p(_sentence(rnd, 3, 9)))

    def _label_of(good):
        return say(_label(rnd), good)

    def body():
        parts = [f"<h1>{say(_label(rnd) if rnd.random() < 0.5 else _sentence(rnd, 3, 8), True)}</h1>"]
        for _ in range(rnd.randint(2, 9)):
            kind = rnd.random()
            if kind < 0.68:
                parts.append(f"<p>{say(_prose(rnd), True)}{rnd.choice(['</p>', '</p>', ''])}")
            elif kind < 0.76:
                parts.append(f"<h2>{say(_label(rnd), True)}</h2>")
            elif kind < 0.84:
                parts.append("<ul>" + "".join(f"<li>{say(_label(rnd) if rnd.random() < 0.5 else _sentence(rnd), True)}</li>" for _ in range(rnd.randint(2, 4))) + "</ul>")
            elif kind < 0.9:
                text = _sentence(rnd, 3, 6)
                say(text, True)
                parts.append(f"<p>{_link(rnd, text)}</p>")
            elif kind < 0.93:
                parts.append(f'<p class="{rnd.choice(["social-science", "ad-hoc", "notice-period"])}">{say(_prose(rnd), True)}</p>')
            elif kind < 0.97:
                parts.append(f"<p>{say(_sentence(rnd, 1, 2), True)}</p>")
            else:
                parts.append(boiler())
        return "".join(parts)

    simple = rnd.random()
    if simple < 0.15:
        menu = f"<nav>{links() if rnd.random() < 0.5 else say(_label(rnd), False)}</nav>" if rnd.random() < 0.5 else ""
        return f"<html><body>{menu}{body() if rnd.random() < 0.5 else '<p>' + say(_sentence(rnd, 2, 8), True) + '</p>'}</body></html>", blocks
    if simple < 0.3:
        return "<br><hr>".join(say(rnd.choice([_sentence, _prose, lambda r: _prose(r)[:-1]])(rnd), True) for _ in range(rnd.randint(1, 4))), blocks
    head = "".join(boiler() for _ in range(rnd.randint(0, 3)))
    if rnd.random() < 0.5:
        head = element(["header"], ["", "masthead"], lambda: f"<div>{_label_of(False)}</div>" + links()) + head if not head else head
    semantic = rnd.random() < 0.5
    main = element(["article", "main"] if semantic else ["div"], ["", "", "x-9", "content", "content-search"] if semantic else ["content", "post", "article-body", "entry"], body)
    tail = "".join(boiler() for _ in range(rnd.randint(0, 3)))
    foot = element(["footer", "div"], ["footer", "site-footer", "legal"], lambda: f"<p>{say('&copy; ' + _sentence(rnd), False)}</p>")
    return f"<html><head><title>t</title></head><body>{head}{main}{tail}{foot}</body></html>", blocks


def pages(seed, n, bare=0.2):
    rnd = random.Random(seed)
    return [page(rnd, bare) for _ in range(n)]
