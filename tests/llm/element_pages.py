"""Hand-labelled pages whose articles hold every kind of element that carries text; lines that begin with + are article text."""

TEXT = [
    "The river rose again last night and the lower meadows are under water.", "Farmers moved their cattle to the hill on Sunday, before the rain began.",
    "Nobody was hurt, but the old bridge will stay closed until the spring.", "Engineers want to look at its piers as soon as the flood has gone down.",
    "The council met on Monday and voted for a new embankment north of the mill.", "It will cost four million and should be ready in two years.",
]
KINDS = {
    "list": "<ul><li>+Sand bags are at the fire station</li><li>+Blankets are at the school</li><li>+Call before you come</li></ul>",
    "numbers": "<ol><li>+Turn off the gas.</li><li>+Leave by the upper road.</li></ol>",
    "table": "<table><tr><th>+Place</th><th>+Level</th></tr><tr><td>+Mill</td><td>+4.20 m</td></tr><tr><td>+Old bridge</td><td>+5.10 m</td></tr></table>",
    "body": "<table><thead><tr><th>+Day</th></tr></thead><tbody><tr><td>+Sunday the rain began</td></tr><tr><td>+Monday the council met</td></tr></tbody></table>",
    "pre": "<pre>+level = gauge.read()\nprint(level)</pre>",
    "quote": "<blockquote>+I have never seen the water so high, said the miller.</blockquote>",
    "quote_p": "<blockquote><p>+We shall rebuild it, the mayor told us.</p></blockquote>",
    "caption": "<figure><img src=a.jpg><figcaption>+The bridge on Sunday evening</figcaption></figure>",
    "definitions": "<dl><dt>+Pier</dt><dd>+A pillar that carries a bridge.</dd><dt>+Gauge</dt><dd>+A staff that shows the level of water.</dd></dl>",
    "headings": "<h2>+What comes next</h2><h3>+Costs</h3>",
    "links": "<p>+See <a href=/a>the report of the council</a> and the map.</p><ul><li>+<a href=/b>Map of the flood</a></li></ul>",
}
NOTICES = {
    "notice": '<div class="notice">We use cookies to make this site work for you.</div>', "advert": '<div class="advert">Buy boots now</div>', "share": '<div class="share"><a href=/x>Share this</a></div>',
    "newsletter": '<form class="newsletter"><div>Get our letters every week</div></form>', "comments": '<section id="comments"><div class="comment"><p>Jo</p><p>Glad that nobody was hurt.</p></div></section>',
}
HEAD = '<html><head><title>Flood - Example</title></head><body><header class="site-header"><a href=/>Example Press</a></header><nav><ul><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li><li><a href=/w>World</a></li></ul></nav>'
FOOT = '<aside><h3>Related</h3><ul><li><a href=/y>Last year\'s flood</a></li><li><a href=/z>The mill</a></li></ul></aside><footer>© 2024 Example Press. All rights reserved.</footer></body></html>'
OUTER = {"article": ("<article>", "</article>"), "main": ("<main>", "</main>"), "post": ('<div class="post-body">', "</div>"), "plain": ('<div class="c7">', "</div>")}


def pages() -> list[tuple[str, str]]:
    """(what it tries, html): each kind of element, alone and all together, in each container; each notice inside an article."""
    out = []
    p = [f"<p>+{t}</p>" for t in TEXT]
    for outer, (begin, end) in OUTER.items():
        for kind, html in KINDS.items():
            out.append((kind, f"{HEAD}{begin}<h1>+Flood closes bridge</h1>{p[0]}{p[1]}{html}{p[2]}{p[3]}{end}{FOOT}"))
        out.append(("together", f"{HEAD}{begin}<h1>+Flood closes bridge</h1>{p[0]}{''.join(f'{h}{p[n % 6]}' for n, h in enumerate(KINDS.values()))}{end}{FOOT}"))
        if outer != "plain":
            for kind, html in NOTICES.items():
                out.append((kind, f"{HEAD}{begin}<h1>+Flood closes bridge</h1>{p[0]}{p[1]}{html}{p[2]}{p[3]}{end}{FOOT}"))
    divs = "".join(f"<div>+{t}</div>" for t in TEXT)
    out.append(("divs", f"<html><body><div class=q><div><a href=/>Home</a></div><div><a href=/n>News</a></div></div><div class=r><div>+Flood closes bridge</div>{divs}</div><div class=s>© 2024 Example Press</div></body></html>"))
    return out
