"""Seed words of abuse: what the learner starts from.

Fixed values, written from general knowledge of the four languages, not from any corpus.  They are the informative part of
the Dirichlet prior: every other word's and every phrase's weight is learnt (``abuse.py``).  Text is folded: lower case, no
accents.  ``SURE`` words stand for abuse nearly whenever they are used, ``LIKELY`` ones often, ``MAYBE`` ones now and then.
"""

from __future__ import annotations

#: Sexual words, which speaking of oneself does not soften.
EXPLICIT = "porn xxx milf milfs blowjob handjob cumshot gangbang dildo horny wank wanks wanking masturbate masturbates masturbating tits pussy nudes"
SURE = {
    "en": "wanker wankers cunt cunts dickhead dickheads arsehole arseholes asshole assholes bastard bastards bitch bitches whore whores slut sluts "
    "twat twats tosser tossers scumbag scumbags moron morons imbecile imbeciles cretin cretins retard retards dumbass braindead lowlife lowlifes "
    "subhuman subhumans motherfucker shithead bellend faggot faggots nigger kike spastic poof poofs queers tranny mong mongs "
    + EXPLICIT,
    "de": "hurensohn wichser arschloch fotze schlampe missgeburt drecksau schwuchtel kanake kanaken ungeziefer untermensch untermenschen ficken fick titten nutte abschaum",
    "es": "gilipollas cabron cabrones maricon maricones subnormal follar follada tetas puta putas polla",
    "fr": "connard connards connasse salope salopes encule encules pute putes bougnoule bite nique",
}
LIKELY = {
    "en": "idiot idiots prick pricks pig pigs cockroach cockroaches parasite parasites vermin scum inbred retarded degenerate degenerates lice rat rats swine "
    "worthless spineless brainless dick cock cripples",
    "de": "idiot schwein pack fresse maul parasiten ratten dreckiger verrecke",
    "es": "imbecil cerdo zorra escoria mierda ratas cucarachas",
    "fr": "cretin abruti batard ordure vermine gueule racaille creve crevent rats baiser foutre",
}
MAYBE = {
    "en": "animals stinking slimy lying filthy disgusting ugly useless pathetic stupid dirty fucking cunting filth plague",
    "de": "dummes dummer verdammter geile",
    "es": "asqueroso inutil",
    "fr": "sale espece gros",
}
#: Fixed expressions of contempt, threat and sexual demand whose single words are harmless.
PHRASES = (
    "piece of shit", "waste of oxygen", "waste of space", "fuck you", "fuck off", "piss off", "drop dead", "kill yourself", "hang yourself",
    "shut your mouth", "kill you", "stab you", "shoot you", "slit your throat", "break your legs", "know where you live", "deserve to die",
    "deserves to die", "hope you die", "hope he dies", "burn in hell", "gets cancer", "suck my", "want to fuck", "sex tape", "jerks off",
    "never have been born", "halt die", "bring dich um", "wo du wohnst", "fick dich", "hijo de puta", "te voy a matar", "donde vives",
    "ojala te mueras", "va te faire", "fils de pute", "te tuer", "tu habites", "ta gueule",
)
#: Words by which texts report, punish or quote such language, or turn on the speaker.
REPORTS = (
    "condemned apologised apologized banned ban fined court sentenced arrested police charged threatened abuse documentary museum "
    "verurteilte verurteilt entschuldigte gesperrt polizei beleidigungen condeno denuncio multa policia insultos condamne amende police insultes"
)


def seeds() -> dict[tuple[str, ...], float]:
    """Every seed with the share of its uses that is abuse, before any evidence."""
    out: dict[tuple[str, ...], float] = {}
    for share, table in ((0.2, MAYBE), (0.6, LIKELY), (0.95, SURE)):
        for words in table.values():
            out.update({(w,): share for w in words.split()})
    out.update({tuple(p.split()): 0.95 for p in PHRASES})
    return out


def explicit_words() -> set[str]:
    return set(EXPLICIT.split())


def report_words() -> set[str]:
    return set(REPORTS.split())
