"""A small labelled URL table to train the URL filter on.

The hosts are invented (reserved top-level names), the words in them are those that pages of a kind put into their addresses.
Both kinds use the same endings, subdomains and path forms, so that only the words tell them apart.
"""

from __future__ import annotations

#: Fixed values, by hand: gambling, pills, adult pages, advertising and tracking, spam, scams and pirated goods.
BLOCKED = """
http://casino-royal.test/play/1 https://www.lucky-casino.example/en/bonus http://online-casino.invalid/en/201 https://m.casino-spin.test/de/77.html http://blog.vegas-casino.example/en/9
https://free-slots.test/en/12 http://www.slot-machine.example/fr/spin http://poker-win.invalid/en/31?page=2 https://m.poker-bonus.test/es/5 https://bets-online.example/en/44
http://free-bet.invalid/fr/3 https://www.sports-bets.test/de/81 http://betting-tips.example/en/7.html https://m.jackpot-win.invalid/en/66 http://big-jackpot.test/es/90#top
https://cheap-viagra.example/en/4 http://www.pills-online.invalid/en/18 https://discount-pills.test/fr/22?ref=x http://cheap-meds.example/de/6 https://m.pharma-deal.invalid/en/58
http://buy-cialis.test/en/71.html https://www.weight-loss-pills.example/es/13 http://diet-pills.invalid/en/29 https://cheap-drugs.test/en/33#top http://pill-shop.example/fr/64
https://adult-videos.example/en/8 http://www.adult-cams.invalid/en/10 https://xxx-video.test/de/2 http://m.hot-xxx.example/en/55?page=3 https://sex-cams.invalid/fr/41
http://adult-dating.test/en/19 https://www.porn-tube.example/en/23 http://free-porn.invalid/es/37.html https://escort-girls.test/en/48 http://x-adult.example/en/50
https://ads-server.example/en/1 http://www.ads-click.invalid/track/7 https://track-ads.test/en/9?utm_source=feed http://ad-tracker.example/de/14 https://m.tracking-pixel.invalid/en/88
http://banner-ads.test/fr/26 https://www.popup-ads.example/en/39 http://click-track.invalid/en/52.html https://adserve.test/es/67 http://pay-per-click-ads.example/en/72
https://spam-links.example/en/3 http://www.link-farm.invalid/en/16 https://spam-blog.test/de/28?page=2 http://m.seo-spam.example/en/45 https://article-farm.invalid/fr/59
http://content-farm.test/en/62 https://www.spammy-offers.example/en/74 http://bulk-mail-spam.invalid/es/85.html https://farm-links.test/en/91 http://spam-mailer.example/en/99#top
https://free-money.example/en/2 http://www.win-prize.invalid/en/11 https://easy-loan.test/de/24 http://payday-loans.example/en/36 https://m.get-rich-quick.invalid/fr/47
http://crypto-doubler.test/en/53 https://www.free-gift-cards.example/en/68 http://fake-watches.invalid/es/79 https://replica-bags.test/en/83.html http://cheap-replica.example/en/95
https://warez-download.example/en/5 http://www.crack-serial.invalid/en/17 https://keygen-crack.test/de/21 http://torrent-warez.example/en/34 https://free-cracks.invalid/fr/43
""".split()

#: Fixed values, by hand: libraries, schools, news, science, code, hobbies, towns, shops of plain goods.
ALLOWED = """
http://city-library.test/en/1 https://www.open-library.example/en/books http://library-news.invalid/en/201 https://m.school-book.test/de/77.html http://blog.book-review.example/en/9
https://town-school.test/en/12 http://www.high-school.example/fr/term http://teachers-room.invalid/en/31?page=2 https://m.learn-maths.test/es/5 https://university-press.example/en/44
http://science-daily.invalid/fr/3 https://www.star-atlas.test/de/81 http://weather-station.example/en/7.html https://m.ocean-study.invalid/en/66 http://plant-guide.test/es/90#top
https://garden-notes.example/en/4 http://www.bread-recipes.invalid/en/18 https://kitchen-table.test/fr/22?ref=x http://hiking-trails.example/de/6 https://m.river-walks.invalid/en/58
http://mountain-club.test/en/71.html https://www.bird-watching.example/es/13 http://chess-club.invalid/en/29 https://music-lessons.test/en/33#top http://piano-school.example/fr/64
https://morning-paper.example/en/8 http://www.evening-news.invalid/en/10 https://local-news.test/de/2 http://m.world-report.example/en/55?page=3 https://radio-station.invalid/fr/41
http://history-museum.test/en/19 https://www.art-gallery.example/en/23 http://town-theatre.invalid/es/37.html https://old-maps.test/en/48 http://national-archive.example/en/50
https://code-notes.example/en/1 http://www.python-docs.invalid/guide/7 https://linux-manual.test/en/9?utm_source=feed http://data-structures.example/de/14 https://m.web-tutorial.invalid/en/88
http://compiler-book.test/fr/26 https://www.math-forum.example/en/39 http://physics-notes.invalid/en/52.html https://chemistry-lab.test/es/67 http://open-source-tools.example/en/72
https://city-council.example/en/3 http://www.public-transport.invalid/en/16 https://train-times.test/de/28?page=2 http://m.post-office.example/en/45 https://health-service.invalid/fr/59
http://hospital-info.test/en/62 https://www.fire-service.example/en/74 http://tax-office.invalid/es/85.html https://water-works.test/en/91 http://village-hall.example/en/99#top
https://wool-shop.example/en/2 http://www.shoe-store.invalid/en/11 https://bike-repair.test/de/24 http://furniture-maker.example/en/36 https://m.tea-house.invalid/fr/47
http://travel-diary.test/en/53 https://www.photo-album.example/en/68 http://family-tree.invalid/es/79 https://pet-care.test/en/83.html http://dog-training.example/en/95
https://the-onward.example/en/5 http://www.tressing.invalid/en/17 https://hanover.test/de/21 http://leonard.example/en/34 https://thornton.invalid/fr/43
""".split()

LABELLED = [(url, 0) for url in BLOCKED] + [(url, 1) for url in ALLOWED]
