"""Made-up web pages with known main text, to train and test the block labeller.

Words are random syllables, the same for main text and boilerplate but for a few cue
words, so a model trained on them reads structure and context, not a topic.  A quarter of the
pages has no names of classes at all, or only names without a meaning, so that a model
cannot lean on names alone; there boilerplate shows by its tags, links and cue words.
"""

from __future__ import annotations

import random

#: Cue words of boilerplate by its part, in four languages.
CUES = {
    "nav": "home menu about contact news products services login search accueil contacto inicio startseite kontakt über nosotros produits".split(),
    "footer": "copyright © rights reserved privacy terms imprint sitemap contact impressum datenschutz agb mentions légales confidentialité derechos reservados privacidad aviso legal".split(),
    "ad": "advertisement sponsored promoted offer buy sale deal discount anzeige werbung publicité annonce publicidad oferta".split(),
    "notice": "cookie cookies accept consent notice browser javascript update akzeptieren zustimmen accepter consentement aceptar".split(),
    "share": "share tweet print email follow facebook twitter linkedin whatsapp pinterest teilen partager compartir drucken".split(),
    "related": "related popular latest recommended trending more read weitere artikel beliebt lire aussi articles más leídas relacionados".split(),
    "comment": "comment comments reply posted says ago agree thanks great kommentare antworten commentaires répondre comentarios responder".split(),
    "form": "subscribe newsletter email name password submit sign username abonnieren anmelden abonnez inscription suscríbete enviar".split(),
}
#: Closing lines and headings of boilerplate as pages have them; {} is a name, # a year.
LINES = {
    "footer": (
        "Copyright # {}. All rights reserved.", "© # {}", "© # {}. All rights reserved.", "Copyright (c) # {} Ltd.", "{} is a registered trademark. Terms | Privacy",
        "© # {} GmbH. Alle Rechte vorbehalten.", "© # {}. Tous droits réservés.", "© # {}. Todos los derechos reservados.", "Powered by {}. Contact | Imprint | Privacy policy",
    ),
    "share": ("Share this:", "Share", "Share this article", "Follow us", "Share on:", "Teilen:", "Partager :", "Compartir:", "Tweet this"),
    "related": ("Related posts", "Related articles", "You may also like", "More from {}", "Most read", "Popular now", "Weitere Artikel", "À lire aussi", "Más leídas", "Read next"),
    "nav": ("Navigation menu", "Menu", "Navigation", "Main menu", "Site navigation", "Contents", "Sections", "Menü", "Menú"),
    "comment": ("Comments", "3 comments", "Leave a reply", "Discussion", "12 Comments on this story", "Kommentare", "Commentaires", "Comentarios"),
}
#: Names of boxes around the main text that do not tell what is in them, and roles of parts (fixed values of the ARIA standard).
NEUTRAL = "container row col-md-8 wrapper inner document documentwrapper bodywrapper page site outer grid layout col span8 main-col block box".split()
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "main": "main", "form": "search"}
NETWORKS = "Twitter Facebook LinkedIn WhatsApp Email Reddit Pinterest Telegram Print X Mastodon Pocket".split()
#: Class or id names of containers by part.
NAMES = {
    "main": "content main-content post-body entry-content article-body story-body post article text body-text entry story prose page-content mainContent".split(),
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs top-menu main-nav mainMenu toc pagination".split(),
    "header": "header site-header masthead top-bar branding logo topbar".split(),
    "footer": "footer site-footer bottom copyright colophon legal page-footer".split(),
    "ad": "ad ads advert advertisement banner sponsored promo ad-slot adbox".split(),
    "notice": "cookie-notice cookie-banner notice alert gdpr consent popup modal notification".split(),
    "share": "share social social-share share-buttons follow sharing".split(),
    "related": "related related-posts popular more-stories recommended widget latest".split(),
    "comment": "comments comment-list comment discussion replies responses disqus user-comments".split(),
    "form": "newsletter subscribe search-form login signup contact-form".split(),
    "sidebar": "sidebar side-bar aside widget-area rail secondary".split(),
}
#: Words that say nothing about a block, in main text and boilerplate alike.
COMMON = (
    "the of and to a in is that it for on this all from you also may us more read was with by be are as at have new one two last first time out not your our use after before "
    "der die das und in zu den von mit ist auf für nicht ein eine im dem auch alle mehr neue über nach aus am le la les et de des du un une en à que est pour dans qui sur au "
    "plus par aussi lire tous el los las y de del que en un una por con para es su al lo más todos nuevo article post story page people world day years made said"
).split()
SYLLABLES = "an ber ca del en fo ga hin is ja ko lun ma nor op per qua re sta tu un ve wi xo ya zen é ü ñ".split()


class PageMaker:
    """Draws pages from a seed; ``page()`` gives html and the main blocks' texts."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.pool = ["".join(self.r.choices(SYLLABLES, k=k % 4 + 1)) for k in range(200_000)]
        self.style = "named"  # of the page: names with a meaning, "opaque" ones, or "bare" for none

    def word(self) -> str:
        return self.r.choice(COMMON) if self.r.random() < 0.3 else self.pool[int(self.r.random() * len(self.pool))]

    def text(self, low: int, high: int, part: str | None = None) -> str:
        n = int(self.r.uniform(low**0.5, high**0.5) ** 2) + 1
        cues = 0.25 if self.style == "named" else 0.6
        words = [self.r.choice(CUES[part]) if part in CUES and self.r.random() < cues else self.word() for _ in range(n)]
        if self.r.random() < 0.07:  # junk that says one thing again and again
            words = words[: self.r.randint(1, 5)] * (1 + n // 5)
        out = " ".join(words)
        if self.r.random() < 0.1:
            out += " %%% &&&"
        return out[:1].upper() + out[1:] + (self.r.choice((".", ".", "?", "!", "")) if n > 3 or self.r.random() < 0.5 else "")

    def line(self, part: str) -> str:
        return self.r.choice(LINES[part]).replace("{}", " ".join(self.word().title() for _ in range(self.r.randint(1, 3)))).replace("#", str(self.r.randint(1995, 2030)))

    def escaped(self, text: str) -> str:
        return text.replace("&", "&amp;").replace("<", "&lt;")

    def opaque(self) -> str:
        return self.r.choice(("css-%x", "sc-%x", "_%x", "c%x", "mt-4 px-%x", "row b%x", "Box-%x")) % self.r.getrandbits(20)

    def names(self, part: str, attribute: str = "class", chance: float = 1.0) -> str:
        """An attribute with a name of the part, as the page's style has it."""
        role = f' role="{ROLES[part]}"' if part in ROLES and self.r.random() < 0.12 else ""
        if self.style == "bare" or self.r.random() >= chance:
            return role
        return f'{role} {attribute}="{self.opaque() if self.style == "opaque" else self.r.choice(NAMES[part])}"'

    def attr(self, part: str) -> str:
        return self.names(part, self.r.choice(("class", "class", "id")), 0.85)

    def named(self, part: str, tag: str) -> str:
        """A class where the tag does not tell the part, else sometimes."""
        return self.names(part, chance=1.0 if tag == "div" else 0.4)

    def neutral(self) -> str:
        return self.r.choice(("", f' class="{self.r.choice(NEUTRAL)}"', f' id="{self.r.choice(NEUTRAL)}"', f' class="{self.opaque()}"'))

    def tag(self, own: str) -> str:
        """The part's own element, or a div where a name or cue words tell the part."""
        return self.r.choice((own, own, "div")) if self.style == "named" else own

    def links(self, part: str, texts: list[str] | None = None) -> str:
        tag = self.r.choice(("ul", "ul", "ol", "div"))
        item = "li" if tag != "div" else self.r.choice(("span", "p", "div"))
        texts = texts or [self.text(1, 6, part) for _ in range(self.r.randint(1, 8))]
        return f"<{tag}>" + "".join(f'<{item}><a href="/{k}">{self.escaped(t)}</a></{item}>' for k, t in enumerate(texts)) + f"</{tag}>"

    def heading(self, part: str) -> str:
        tag = self.r.choice(("h2", "h3", "h3", "h4", "h5", "p", "div"))
        return f"<{tag}>{self.line(part) if self.r.random() < 0.6 or self.style != 'named' else self.text(1, 4, part)}</{tag}>"

    def row(self, part: str) -> str:
        """Links one after the other in one block."""
        between = self.r.choice(("<br>", " | ", " ", " &middot; ", "\n"))
        return between.join(f'<a href="{k}.html">{self.escaped(self.text(1, 3, part))}</a>' for k in range(self.r.randint(2, 7)))

    def share(self) -> str:
        """A row of links to networks, with or without a heading, a list or a box around it."""
        r, texts, bare = self.r, self.r.sample(NETWORKS, self.r.randint(1, 5)), self.r.random() < 0.25
        head = f"<{(t := r.choice(('h3', 'h4', 'h5') if bare else ('p', 'h3', 'h4', 'div')))}>{self.line('share')}</{t}>" if r.random() < 0.8 else ""
        row = self.links("share", texts) if bare or r.random() < 0.6 else "<p>" + " ".join(f'<a href="/{t}">{t}</a>' for t in texts) + "</p>"
        return head + row if bare else f"<div{self.names('share', chance=0.7)}>{head}{row}</div>"

    def boilerplate(self, part: str) -> str:
        r = self.r
        if part == "nav":
            tag = self.tag("nav")
            inside = self.row("nav") if r.random() < 0.25 else (self.heading("nav") if r.random() < 0.25 else "") + self.links("nav")
            return f"<{tag}{self.attr('nav') if tag == 'div' or r.random() < 0.5 else ''}>{inside}</{tag}>"
        if part == "header":
            inside = f"<{r.choice(('h1', 'div', 'p'))}>{self.escaped(self.text(1, 6))}" + ("" if r.random() < 0.5 else f"<p>{self.text(2, 10)}</p>")
            tag = self.tag("header")
            return f"<{tag}{self.named('header', tag)}>{inside}{self.links('nav') if r.random() < 0.4 else ''}</{tag}>"
        if part == "footer":
            tag = self.tag("footer")
            inside = r.choice((f"&copy; {self.text(1, 8, 'footer')} &middot; {self.text(2, 9)}", f"<p>{self.text(3, 25, 'footer')}</p>", f"{self.links('footer')}<p>{self.text(2, 9, 'footer')}</p>", self.line("footer"), f"<p>{self.line('footer')}</p>"))
            return f"<{tag}{self.named('footer', tag)}>{inside}</{tag}>"
        if part == "closing":  # a footer that only its words tell
            tag = r.choice(("div", "center", "div", "address"))
            return f"<{tag}>{self.line('footer')}</{tag}>"
        if part == "comment":
            items = "".join(f"<{t}{self.names('comment', chance=0.5)}><p>{self.escaped(self.text(2, 60, 'comment'))}</p></{t}>" for t in [r.choice(("li", "li", "div", "div", "article"))] * r.randint(1, 6))
            title = self.heading("comment") if r.random() < 0.6 or self.style != "named" else ""
            return f"<{(t := r.choice(('section', 'div', 'ul')))}{self.names('comment', r.choice(('class', 'id')))}>{title}{items}</{t}>"
        if part == "form":
            return f"<form{self.attr('form')}><label>{self.text(1, 3, 'form')}</label><input name=q><p>{self.text(2, 20, 'form')}</p><button>{self.text(1, 2, 'form')}</button></form>"
        if part == "sidebar":
            tag = self.tag("aside")
            inside = r.choice((f"{self.heading('related')}{self.links('related')}", f"{self.heading('related')}{self.links('nav')}", f"<p>{self.text(3, 40)}</p>", f"<h4>{self.text(1, 4)}</h4><p>{self.text(3, 40)}</p>"))
            return f"<{tag}{self.named('sidebar', tag)}>{inside}</{tag}>"
        if part == "related":
            return f"<{(t := r.choice(('section', 'div')))}{self.names('related')}>{self.heading('related')}{self.links('related')}</{t}>"
        if part == "share" and r.random() < 0.6:
            return self.share()
        inside = self.text(1, 40, part) if r.random() < 0.6 else f"<p>{self.text(1, 40, part)}</p>"
        return f"<div{self.names(part, r.choice(('class', 'id')))}>{inside}</div>"

    def main(self) -> tuple[str, list[str]]:
        r, out, texts = self.r, [], []

        def block(tag: str, low: int, high: int, close: bool = True) -> None:
            text = self.text(low, high)
            texts.append(text)
            inner = self.escaped(text)
            if r.random() < 0.15:
                inner = f"<b>{inner}" + r.choice(("<br>", "</b>", ""))
            elif r.random() < 0.2:
                inner = f'<a href="#">{inner[:12]}</a>{inner[12:]}' if "&" not in inner[:12] else inner
            out.append(f"<{tag}>{inner}" + (f"</{tag}>" if close else ""))

        if r.random() < 0.85:
            block("h1", 1, 14)
        for _ in range(int(r.uniform(1, 5) ** 2) if r.random() < 0.95 else r.randint(25, 60)):
            kind = r.random()
            if kind < 0.02:  # such lines within the article are its text
                texts.append(self.line("footer"))
                out.append(f"<p>{self.escaped(texts[-1])}</p>")
            elif kind < 0.72:
                block("p", 1, 6 if r.random() < 0.1 else 150, r.random() < 0.8)
            elif kind < 0.8:
                block(r.choice(("h2", "h3")), 1, 9)
            elif kind < 0.86:
                out.append("<ul>")
                for _ in range(r.randint(1, 5)):
                    block("li", 1, 20, r.random() < 0.8)
                out.append("</ul>")
            elif kind < 0.89:
                block(r.choice(("blockquote", "pre")), 2, 50)
            elif kind < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{self._cell(texts)}<td>{self._cell(texts)}</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.97:
                out.append(self.boilerplate(r.choice(("ad", "ad", "share", "related", "form", "sidebar", "notice"))))
            else:
                block("div", 2, 60)
        return "".join(out), texts

    def _cell(self, texts: list[str]) -> str:
        texts.append(self.word())
        return texts[-1]

    def page(self) -> tuple[str, list[str]]:
        r = self.r
        self.style = r.choice(("named", "named", "named", "named", "named", "named", "opaque", "bare"))
        main, texts = self.main()
        if not texts:
            texts, main = ["Only."], "<p>Only.</p>"
        tag = r.choice(("article", "article", "main", "div", "section"))
        if r.random() > 0.06:  # else its blocks are the body's own
            main = f"<{tag}{self.named('main', tag)}>{main}</{tag}>"
        if tag == "article" and r.random() < 0.3:
            main = f"<main>{main}</main>"
        side = self.boilerplate(r.choice(("sidebar", "nav", "sidebar"))) if r.random() < 0.25 else ""
        plain = r.random() < 0.2  # no boxes around
        for k in range(0 if plain else r.choice((0, 0, 0, 0, 1, 1, 2, 3))):
            beside = side if k == 0 and r.random() < 0.7 else ""
            main = f"<div{self.neutral()}>{main}</div>"
            main = beside + main if r.random() < 0.3 else main + beside
        if r.random() < 0.08:  # columns by a table
            cell = f"<td>{self.row('nav') if r.random() < 0.7 else self.links('nav')}</td>"
            cells = f"{cell}<td>{main}</td>" if r.random() < 0.7 else f"<td>{main}</td>{cell}"
            main = f"<table><tr>{cells}</tr></table>"
        before = [self.boilerplate(p) for p in ("header", "nav", "nav", "ad", "notice", "form", "sidebar", "share") if r.random() < 0.45]
        after = [self.boilerplate(p) for p in ("share", "ad", "related", "comment", "comment", "sidebar", "form", "footer", "footer", "notice") if r.random() < 0.4]
        r.shuffle(before)
        if r.random() < 0.3:
            r.shuffle(after)
        if r.random() < 0.25:
            after.append(self.boilerplate("closing"))
        middle = "".join([*before, main, *after])
        for _ in range(0 if plain else r.choice((0, 0, 0, 1, 2))):
            middle = f"<div{self.neutral()}>{middle}</div>"
        head = f'<head><meta charset="utf-8"><title>{self.text(1, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        return f"<!DOCTYPE html><html>{head}<body>{middle}" + r.choice(("</body></html>", "")), texts
