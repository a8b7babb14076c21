"""The small labelled table of the main-text classifier: pages whose elements say with data-label whether their text is the article's (1) or not (0)."""

from __future__ import annotations

#: Written for this purpose. Long sentences, one-word paragraphs, links in the text, and the usual surroundings, with and without telling names.
PAGES = (
    """<html><body><header data-label="0"><a href="/">The Daily Harbour</a> <p>News from the coast since 1902</p></header>
    <nav><ul data-label="0"><li><a href="/a">Home</a></li><li><a href="/b">Sport</a></li><li><a href="/c">Weather today</a></li></ul></nav>
    <article data-label="1"><h1>Ferry service returns after winter repairs</h1><p>The ferry between the two islands will sail again from Monday, the harbour office said, after a winter of repairs to the engine and the hull.</p>
    <p>Finally.</p><p>Tickets can be bought at the <a href="/t">ticket office</a> or on board; children under six travel free of charge on all days of the week.</p></article>
    <aside data-label="0"><h2>Most read</h2><p>Storm closes coast road for the third time this month, drivers are asked to take the inland route</p></aside>
    <footer data-label="0">&copy; The Daily Harbour. All rights reserved by the publisher and its partners.</footer></body></html>""",
    """<html><body><div class="cookie-notice" data-label="0"><p>We use cookies to make this site work and to measure how it is used. By going on you agree to our policy.</p><button>Accept</button></div>
    <div id="menu" data-label="0"><a href="/">Start</a> | <a href="/news">News</a> | <a href="/about">About us</a></div>
    <div class="ad" data-label="0">Buy two pairs of shoes and get the third one free.</div>
    <div class="content" data-label="1"><h1>How bread rises</h1><p>Yeast eats sugar and gives off gas, which is held in the dough by a net of gluten and makes the loaf rise in the warm oven.</p><p>Wait.</p><p>Then knead the dough again and leave it to rest under a cloth until it has doubled in size.</p></div>
    <div class="comments" data-label="0"><h3>3 comments</h3><p>I tried this last week and my loaf came out far better than the ones I have bought in the shop for years.</p><p>Thanks!</p></div></body></html>""",
    """<html><body><table><tr><td data-label="0"><a href="/1">One</a></td><td data-label="0"><a href="/2">Two and more</a></td><td data-label="0"><a href="/3">Three</a></td></tr></table>
    <h2 data-label="1">A walk along the old canal</h2>
    <p data-label="1">The path follows the water for eleven miles and passes four locks, two of which still have their wooden gates and the huts of the keepers.</p>
    <p data-label="1">Most walkers turn back at the second lock, where a small shop sells tea and cake to those who come before four in the afternoon.</p>
    <p data-label="1">The way back is shorter, as the road cuts through the woods and meets the canal again at the bridge near the station.</p>
    <p data-label="0"><a href="/prev">Previous page</a> <a href="/next">Next page</a></p>
    <p data-label="0">Copyright notice</p></body></html>""",
    """<html><body><div class="topbar" data-label="0">Call us now on this number, we are open from nine to five on all working days.</div>
    <header class="site-header" data-label="0"><h1>Garden World</h1><p>Everything for your garden, delivered to your door within two days of your order.</p></header>
    <main data-label="1"><h2>Pruning apple trees</h2><p>Cut in late winter, before the buds swell, and take out dead wood first so that light reaches the middle of the tree.</p><ul><li>Sharp saw</li><li>Ladder</li><li>Gloves for the thorny shoots of old trees</li></ul><p>Never cut more than a third of the crown in one year.</p></main>
    <div class="related-posts" data-label="0"><h4>You may also like</h4><ul><li><a href="/x">Ten plants for shade</a></li><li><a href="/y">The best soil for roses in pots</a></li></ul></div>
    <form data-label="0"><label>Your name</label><label>Your message to the gardeners of our shop, in a few words</label><input type="submit"></form></body></html>""",
    """<html><body><div data-label="0"><a href="/">Accueil</a> <a href="/actu">Actualités</a> <a href="/sport">Sport</a> <a href="/meteo">Météo</a></div>
    <div data-label="1"><p>Le conseil municipal a voté hier soir la construction d'une nouvelle école au bord de la rivière, après trois heures de débat avec les habitants.</p>
    <p>Les travaux doivent commencer au printemps et durer deux ans, selon le maire, qui promet aussi un <a href="/p">parc</a> ouvert à tous les enfants du quartier.</p></div>
    <div data-label="0"><a href="/a1">Un incendie détruit une grange</a></div><div data-label="0"><a href="/a2">La piscine ferme pour travaux</a></div><div data-label="0">Partager</div></body></html>""",
    """<html><body><section id="comments" data-label="0"><article><p>What a lovely story, I remember my grandmother telling me about the same mill when I was a child.</p></article><article><p>Agreed.</p></article></section>
    <div class="post" data-label="1"><h1>The mill by the brook</h1><p>For two hundred years the mill ground the corn of five villages, until the brook was led into a pipe and the wheel stood still.</p><blockquote>It was never quiet here.</blockquote><p>Today a family lives in it.</p></div>
    <div class="sidebar" data-label="0"><p>About the author: she has written three books on the history of the valley and lives near the mill with two dogs.</p></div>
    <div class="newsletter" data-label="0"><p>Get our best stories by mail every Friday morning, free of charge and without advertising of any kind.</p></div></body></html>""",
    """<html><body><nav data-label="0"><a href="/de">Startseite</a> <a href="/de/1">Aktuelles</a></nav><!-- ad --><div class="ad" data-label="0">Jetzt neu.</div>
    <article data-label="1"><h1>Neue Brücke</h1><p><b>Die Stadt baut eine Brücke über den Fluss.<br></b><p>Ja.</p><p>Sie soll im Herbst fertig sein und den Weg zum Bahnhof für alle verkürzen, die heute noch den Umweg über die alte Straße nehmen.</p><p><a href="/plan">Plan der Brücke</a></p></article>
    <footer data-label="0">&copy; stadt.example Impressum. Die Redaktion freut sich über Hinweise und Bilder ihrer Leserinnen und Leser.</footer></body></html>""",
    """<html><body><p data-label="0">Sign in</p><p data-label="0"><a href="/r">Register now</a></p>
    <h1 data-label="1">Why the sky is blue</h1><p data-label="1">Light from the sun is scattered by the air, and short waves far more than long ones, so that blue reaches us from all sides.</p>
    <p data-label="1">In the evening the way through the air is longer; most of the blue is lost and what is left is the red of the sunset.</p><p data-label="0">Share this</p><p data-label="0"><a href="/1">Next: why the sea is salty</a></p></body></html>""",
    """<html><body><article data-label="1"><header><h1>Snow in May</h1></header><p>Snow fell on the hills last night for the first time in May since records began in the village, and the lambs had to be brought down.</p><p>Cold.</p>
    <aside data-label="0"><p>Read all about the weather of the last years in our large archive of reports and pictures from readers.</p></aside><p>The forecast speaks of warmer days from Thursday on.</p></article>
    <div role="contentinfo" data-label="0"><p>Terms of use and a list of all our pages for readers and for machines.</p></div></body></html>""",
    """<html><body><div data-label="0"><a href="/1">Storm warning for the northern coast until Friday</a> <a href="/2">Parliament votes on the new budget after a long night</a> <a href="/3">Local team wins the cup for the second time in ten years</a> <a href="/4">Prices of bread and milk rise again</a></div>
    <div data-label="1">A new kind of beetle has been found in the dead wood of the old forest, where researchers had set up traps for three summers in a row without success until last month.</div><div data-label="1">It is green, as long as a finger nail, and it sings.</div>
    <div data-label="1">Its song is too high for our ears; the researchers heard it only when they slowed down a recording made for a study of bats, and they went back to the <a href="/forest">forest</a> the next day to look for the singer under the bark.</div>
    <div data-label="0"><a href="/5">Ten walks through forests that have never been cut, with maps and pictures by our readers</a> <a href="/6">How to build a house for wild bees in your own garden or on a balcony in town</a> <a href="/7">All reports on animals</a></div></body></html>""",
)
