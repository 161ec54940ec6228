"""The labelled table of html_text: page layouts whose parts are marked with data-label, 1 for text and 0 for the rest.

{n} stands for n words of running text and [n] for a link of n words. Each layout is filled once for every scale, which
stretches its passages of text (links, labels and headings keep their length), so that the table has blocks of many
sizes: 34 layouts and about 720 blocks, all made up for this purpose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

SCALES = (0.5, 1.0, 2.5)

_PROSE = (
    "The council met again on Tuesday to talk about the bridge over the river, which has been closed since the flood in early spring and may stay so for a year. "
    "Work on the second arch begins next month, and the old stones will be used again wherever they are sound. Ferries take people across in the meantime, but they "
    "stop at dusk. A baker in the upper town says that half of her trade is gone; others have moved their stalls to the far bank, where the market now opens at six. "
    "Engineers found cracks in two of the piers. They will be filled with lime, as they were a century ago, and watched through the winter. Nobody expects the costs to fall."
).split()

LAYOUTS = (
    # news with an advertisement before the article
    "<body><nav data-label=0><ul><li>[1]</li><li>[1]</li><li>[2]</li></ul></nav><div class=ad data-label=0>{8}</div><article data-label=1><h1>{9}</h1><p>{60}</p><p>{2}</p><p><b>{25}<br></b>{12}</p><p>{5}</p></article><footer data-label=0>{7}</footer></body>",
    "<body><header data-label=0><p>{2}</p><p>{12}</p></header><nav data-label=0>[1] [2] [1] [1]</nav><article data-label=1><header><h1>{7}</h1><p>{4}</p></header><p>{45}</p><p>{1}</p><p>{14} [3] {9}</p><p>[2]</p><p>[4]</p><div class=ad data-label=0>{15}</div><p>{3}</p></article><aside data-label=0><h3>{2}</h3><p>[5]</p><p>{30}</p></aside><footer data-label=0>{5} [1]</footer></body>",
    # names that mislead: what they hold is the article
    "<body><div data-label=0>[1] [1] [2] [1]</div><main data-label=1><h1>{5}</h1><div class=teaser>{28}</div><div class='social history'><p>{50}</p><p>{30} [2] {20}</p></div><section class=widget-repair><p>{40}</p><p>{25}</p></section><p>{18}</p></main><div class=share data-label=0>{1} [1] [1]</div><p data-label=0>{4} [1]</p></body>",
    "<body><div class=topbar data-label=0>[1] [1]</div><div class=related-work data-label=1><h2>{3}</h2><p>{55}</p><p>{34}</p></div><div class=banner data-label=1><p>{48}</p><p>{61}</p></div><div class=related data-label=0>{2} [6] [7]</div><div class=teaser data-label=0>[4]</div><div class=social data-label=0>{2}</div></body>",
    # no names at all: sizes, links and neighbours have to tell
    "<body><div><p data-label=0>[1] [1] [1]</p></div><div data-label=1><p>{40}</p><p>{22}</p><p>{9}</p><p>{33} [2] {10}</p></div><div data-label=0><p>[3]</p><p>[4]</p><p>[2]</p></div><div data-label=0>{3} [1]</div></body>",
    "<body><table><tr><td data-label=0>[1]</td><td data-label=0>[2]</td><td data-label=0>[1]</td></tr><tr><td data-label=1>{70}</td></tr><tr><td data-label=1>{35} [2] {18}</td></tr><tr><td data-label=0>[2]</td><td data-label=0>[3]</td></tr></table></body>",
    "<body><p data-label=0>[1] | [1] | [1]</p><h1 data-label=1>{6}</h1><p data-label=1>{52}</p><p data-label=1>{12}</p><p data-label=1>{80}</p><p data-label=0>[2]</p><p data-label=0>{1}</p><p data-label=0>[1] [1]</p></body>",
    "<body><ul data-label=0><li>[2]</li><li>[3]</li><li>[2]</li><li>[2]</li></ul><div data-label=1>{44}</div><div data-label=1>{16} [2] {30}</div><ul data-label=0><li>[4]</li><li>[5]</li><li>[3]</li></ul><div data-label=0>{2} [2]</div></body>",
    "<body><div data-label=0>[2]</div><div data-label=0>[1]</div><div data-label=1><h2>{4}</h2><p>{38}</p><ul><li>{6}</li><li>{9}</li><li>{7} [2]</li></ul><p>{29}</p></div><div data-label=0>[6]</div><div data-label=0>[5]</div><div data-label=0>{2}</div></body>",
    # blogs and forums with comments
    "<body><div id=menu data-label=0>[1] [2]</div><div class=content data-label=1><h2>{3}</h2><p>{36}</p><p>{11}</p><blockquote>{20}</blockquote><p>{42}</p></div><div class=comments data-label=0><h3>{2}</h3><p>{33}</p><p>{1}</p><p>{18}</p><form><p>{5}</p></form></div><p data-label=0>[1]</p></body>",
    "<body><article data-label=1><h1>{8}</h1><p>{25}</p><p>{3}</p><section class=comments data-label=0><h2>{1}</h2><div>{40}</div><div>{12}</div><div>{2}</div></section></article><div class=sidebar data-label=0><p>{16}</p><p>[2]</p><p>{45}</p></div></body>",
    "<body><main data-label=1><h1>{4}</h1><p>{30}</p><div class=reply data-label=0>{22}</div><div class=reply data-label=0>{48} [1]</div></main><footer data-label=0><p>{20}</p></footer></body>",
    # notices, newsletters, forms
    "<body><div class=cookie-notice data-label=0><p>{3} {20} [2]</p><p>{35}</p></div><main data-label=1><h1>{2}</h1><p>{1}</p><ul><li>{2}</li><li>{3}</li></ul><p>{48}</p><p>{15}</p></main><form data-label=0><p>{18}</p><label>{1}</label></form><footer data-label=0><p>{40}</p></footer></body>",
    "<body><div class=newsletter data-label=0>{30}</div><div data-label=1><p>{26}</p><p>{66}</p></div><div class=popup data-label=0><p>{24}</p></div><div class='ad-slot' data-label=0>{28}</div><div role=contentinfo data-label=0>{14}</div></body>",
    "<body><div class=notice data-label=0>{38}</div><article data-label=1><p>{19}</p><p>{5}</p><aside data-label=0><p>{26}</p><p>{2}</p></aside><p>{31}</p><p>[5]</p><p>[1]</p><p>[4]</p></article><div class=sponsored data-label=0>{55}</div></body>",
    # handbooks, with many links and short lines in the text
    "<body><div class=breadcrumbs data-label=0>[1] [2] [2]</div><main data-label=1><h1>{3}</h1><p>{12} [1] {10} [2] {8}</p><h2>{2}</h2><p>{4} [2] {6}</p><pre>{9}</pre><ol><li>{5}</li><li>[2] {7}</li><li>[3]</li></ol><p>{21}</p></main><nav data-label=0>[2] [2]</nav></body>",
    "<body><div data-label=0>[1] [1] [1] [1]</div><h1 data-label=1>{2}</h1><p data-label=1>{24} [1] {16} [1] {12}</p><h2 data-label=1>{2}</h2><p data-label=1>{37}</p><h2 data-label=1>{3}</h2><p data-label=1>{46} [2]</p><p data-label=0>[3] [2] [4]</p><p data-label=0>[2]</p></body>",
    # shops and landing pages: mostly parts beside the text
    "<body><header data-label=0>{3}</header><div class=menu data-label=0>[1] [1] [1]</div><div data-label=0>[4]</div><div data-label=0>[3]</div><div data-label=0>[5]</div><article data-label=1><p>{27}</p></article><div data-label=0>[2]</div><div class=promo data-label=0>{21}</div></body>",
    "<body><div class=widget data-label=0>{6} [3]</div><div class=toolbar data-label=0>[1] [1]</div><div class=share data-label=0>{2}</div><div data-label=1><p>{58}</p><p>{39}</p><p>{41}</p></div><div class=overlay data-label=0>{4} [1]</div><div class=masthead data-label=0>{3}</div></body>",
    # pages that end with their text, or have little else
    "<body><article data-label=1><h1>{5}</h1><p>{30}</p><p>{3}</p></article></body>",
    "<body><article data-label=1><p>{1}</p></article></body>",
    "<body><div data-label=0>[1] [1]</div><main data-label=1><p>{25}</p><p>{2}</p><p>[2]</p></main></body>",
    "<body><div data-label=1><h1>{4}</h1><p>{50}</p><p>{20}</p><p>{6}</p></div></body>",
    "<body><nav data-label=0>[1] [1]</nav><h1 data-label=1>{4}</h1><p data-label=1>{36}</p><p data-label=1>{8}</p></body>",
    "<body><nav data-label=0>[1] [1]</nav><article data-label=1><p>{2}</p></article><div class=ad data-label=0>{6}</div><article data-label=1><h2>{1}</h2><p>{3}</p><p>{2}</p></article></body>",
    "<body><article data-label=1><p>{20}</p><p>[2]</p><p>{19}</p></article></body>",
    "<body><article data-label=1><p>{20} [9]</p><p>{12}</p><p>{1}</p><p>[2]</p><p>{15}</p><p>{1}</p><p>[3]</p><p>{2}</p></article></body>",
    "<body><article data-label=1><h1>{4}</h1><p>[3]</p><p>{40}</p><p>{1}</p><p>[2]</p><p>{1}</p></article><footer data-label=0>{9}</footer></body>",
    "<body><main data-label=1><p>{10} [6]</p><p>{11}</p><p>{1}</p></main></body>",
    "<body><div data-label=1><p>{30}</p><p>{8} [4]</p><p>{20}</p></div></body>",
    "<body><nav data-label=0>[1] [2]</nav><div class=social-studies data-label=1><p>{30}</p><p>{22}</p></div><ul data-label=0><li>[9]</li><li>[12]</li><li>[10]</li></ul></body>",
    "<body><div data-label=0>[9]</div><div data-label=0>[11]</div><div class=banner-weaving data-label=1><p>{40}</p><p>{33}</p></div><div class=related data-label=0>{2} [14] [11]</div></body>",
    "<body><p data-label=1>{3}</p></body>",
    "<body><p data-label=1>{14}</p><p data-label=1>{2}</p></body>",
)


def _fill(layout: str, scale: float, at: int) -> str:
    def words(n: int) -> str:
        nonlocal at
        at += n
        return " ".join(_PROSE[i % len(_PROSE)] for i in range(at - n, at))

    def text(m: re.Match) -> str:
        n = int(m[1])
        return words(max(10, int(n * scale)) if n > 10 else n)

    filled = re.sub(r"\{(\d+)\}", text, layout)
    return re.sub(r"\[(\d+)\]", lambda m: f"<a href=x>{words(int(m[1]))}</a>", filled)


def pages() -> Iterator[str]:
    for i, layout in enumerate(LAYOUTS):
        for j, scale in enumerate(SCALES):
            yield _fill(layout, scale, 17 * i + 5 * j)
