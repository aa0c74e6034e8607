"""A small table of URLs labelled by hand (1: unwanted), all of them invented, on reserved names."""

from __future__ import annotations

_UNWANTED = """
casino-bonus-777.example/slots/free-spins|bestcasino.example/play/jackpot|online-poker-win.example/bonus|slots-empire.example/spin
cheap-pills-online.example/buy/viagra|pharmacy-discount.example/order/cialis|rx-meds.example/no-prescription|pillstore.example/buy-cheap
xxx-videos.example/free/porn|hotcams.example/live/sex|adult-dating.example/hookup|nude-girls.example/gallery/xxx|sexchat.example/cam
free-download-crack.example/keygen/serial|warez-full.example/crack/download|torrent-movies.example/download/free-hd|crackedapps.example/apk-mod
ads.tracker.example/click?aff=12&redirect=x|adserver.example/banner/click.php?id=9|track.clicks.example/r?utm=1&aff=77|pixel.tracker.example/imp?cid=4
shop.example/cart/checkout?session=9a|shop.example/login?next=/account|forum.example/register.php?ref=1|site.example/wp-login.php?redirect_to=x
site.example/user/login|news.example/search?q=abc&sort=price&page=9|store.example/search?filter=red&sort=asc&page=44|site.example/calendar/2031/05?view=day
seo-backlinks.example/buy-links|link-farm.example/directory/submit|articles-spin.example/seo/backlink|cheap-seo.example/buy/traffic
replica-watches.example/buy/rolex|fake-bags.example/cheap/louis|payday-loan-fast.example/apply-now|quick-cash-loans.example/apply|bitcoin-doubler.example/invest
crypto-giveaway.example/claim-free|win-iphone.example/claim/prize|free-gift-cards.example/survey/claim|lottery-winner.example/claim
weightloss-miracle.example/buy-now|miracle-diet-pills.example/order|hot-singles.example/dating/signup|escort-service.example/girls
casino.royal.example/bonus/slots|bet365x.example/bet/odds|sportsbet.example/betting/bonus|poker.example/play/free-chips
xxx.example/porn/teen|porn-tube.example/watch/xxx|camgirls.example/live/nude|sex-stories.example/adult
get-rich-quick.example/make-money-fast|work-from-home.example/earn-cash|mlm-success.example/join-now|forex-signals.example/invest-now
clickbait.example/you-wont-believe?aff=3|popunder.example/redirect?url=x|doubleads.example/adclick?campaign=1|go.affiliate.example/aff?id=1&sub=2
"""
_WANTED = """
en.encyclopedia.example/wiki/photosynthesis|encyclopedia.example/wiki/History_of_Rome|news.example/2021/05/14/climate-report.html|daily.example/world/2020/election-results
university.example/courses/physics/lecture-3|science.example/articles/quantum-computing|journal.example/paper/10-1000-182|arxiv.example/abs/2101-00001
docs.example/python/tutorial/classes.html|docs.example/reference/api/index.html|blog.example/2019/03/how-to-bake-bread|blog.garden.example/posts/growing-tomatoes
library.example/books/moby-dick/chapter-1|poetry.example/authors/emily|history.example/essays/industrial-revolution|museum.example/collection/item/442
gov.example/publications/annual-report-2018|health.example/conditions/diabetes/overview|medical.example/research/vaccines|law.example/cases/1973/summary
recipes.example/soup/tomato-basil|travel.example/guides/lisbon|music.example/reviews/jazz-album|film.example/essays/silent-era
m.news.example/en/48312|blog.stories.example/fr/2211.html|www.magazine.example/de/1882/|press.example/es/9181|m.reading.example/en/152341
https.example/en/44.html|blog.words.example/en/9341|weekly.example/de/7772|m.letters.example/fr/19233/|archive.example/es/55512.html
github.example/project/readme|code.example/questions/1234/how-do-i-sort-a-list|stack.example/questions/991/what-is-a-closure|forum.example/t/welding-tips/382
math.example/lectures/linear-algebra|chem.example/notes/organic-reactions|bio.example/articles/cell-division|astro.example/articles/black-holes
local.example/news/city-council-meeting|sports.example/football/match-report|weather.example/article/storm-season|economy.example/analysis/inflation
school.example/lessons/fractions|kids.example/stories/the-little-fox|language.example/grammar/verbs|philosophy.example/articles/kant
nature.example/species/red-fox|birds.example/guide/robin|ocean.example/articles/tides|geology.example/notes/volcanoes|farm.example/almanac/soil
news.reader.example/en/1822?page=2&ref=x|blog.travel.example/fr/771?page=2&ref=home|m.magazine.example/de/4451?utm_source=feed|stories.example/es/8812?utm_source=newsletter
weekly.example/en/33812?page=3|paper.example/en/2214?ref=front|www.letters.example/de/9914?utm_source=feed|blog.history.example/en/77122?page=2&ref=x
blog.engineer.example/2022/01/designing-bridges|diary.example/2015/07/a-walk-in-the-hills|essays.example/on-friendship|review.example/books/a-new-novel
"""

_ORDINARY = ("/en/1204", "/fr/88.html", "/de/5150/", "/es/77?utm_source=feed", "/2020/06/a-title", "/article/31?page=2&ref=x", "/")
_SIDES = ("", "m.", "www.", "blog.")
#: Hosts that have both wanted and unwanted pages: there the path alone decides.
_SHARED = {"shop.example", "site.example", "forum.example", "news.example", "store.example"}


def _rows() -> list[tuple[str, int]]:
    """The URLs as they are, and each one-sided host with ordinary paths, for its pages are of its kind whatever their path."""
    found = [(u, y) for block, y in ((_UNWANTED, 1), (_WANTED, 0)) for line in block.split() for u in line.split("|") if u]
    hosts = [(u.split("/", 1)[0], y) for u, y in found]
    more = [(_SIDES[(i + k) % 4] + h.removeprefix("m.").removeprefix("www.") + _ORDINARY[(i + 2 * k) % 7], y) for i, (h, y) in enumerate(hosts) if h not in _SHARED for k in range(4)]
    return [("http://" + u, y) for u, y in found + more]


LABELLED = _rows()
