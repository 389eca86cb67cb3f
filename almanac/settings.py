"""Fixed values of the event domain, all of them parameters of the functions that use them."""

# Limits of text preparation, batches and matching.
MIN_TEXT_LENGTH = 350
TEXT_LIMIT = 12000
SNIPPET_BEFORE, SNIPPET_AFTER = 200, 400
MAX_HITS_PER_PAGE, MAX_HITS_PER_BATCH, BATCH_SIZE, MAX_REQUESTS = 35, 55, 8, 40
MIN_FEED_EVENTS, MAX_FEED_EVENTS, MAX_FEED_CANDIDATES, MAX_ICS_LINKS = 3, 60, 2, 3
MAX_DESCRIPTION = 400
STALE_AFTER_DAYS = 10
TITLE_RATIO, TOKEN_JACCARD, CONTAINED_LENGTH, KEYWORD_SUBSTRING = 0.88, 0.60, 12, 6
GAP = " [...] "

# Hosts whose feeds are not used.
FEED_BLOCKLIST = ("www.stadt-oppenheim.de",)

# Words left out of token sets.
STOP_WORDS = (
    "über", "durch", "nach", "beim", "eines", "einer", "einen", "einem", "mit", "und", "oder", "für", "vom", "auf", "dem", "den", "der", "die",
    "das", "des", "aus", "zum", "zur", "von", "im", "in", "am", "an", "bei", "sowie", "wird", "wie", "als", "auch", "sich", "ist", "sind", "uhr",
)

# Month names.
MONTHS = {
    "jan": 1, "januar": 1, "feb": 2, "februar": 2, "mär": 3, "mrz": 3, "märz": 3, "maerz": 3, "apr": 4, "april": 4, "mai": 5, "jun": 6, "juni": 6,
    "jul": 7, "juli": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "okt": 10, "oktober": 10, "nov": 11, "november": 11, "dez": 12, "dezember": 12,
}

# Names and short names of months and days that a date in a text can have.
MONTH_WORDS = (
    "Jan", "Feb", "Mär", "Mrz", "Apr", "Mai", "Jun", "Jul", "Aug", "Sep", "Sept", "Okt", "Nov", "Dez",
    "Januar", "Februar", "März", "April", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember",
)
DAY_WORDS = ("Mo", "Di", "Mi", "Do", "Fr", "Sa", "So")

# Event types in order of priority, with their keywords.
EVENT_TYPES = (
    ("film", ("filmvorführung", "filmvorfuehrung", "filmabend", "kino", "film")),
    ("ausstellung", ("ausstellung", "vernissage", "finissage")),
    ("workshop", ("workshop", "seminar", "fortbildung", "modellier", "ausbildung", "kurs")),
    ("gottesdienst", ("gottesdienst", "messfeier", "trauerfeier", "gedenkfeier", "gedenkveranstaltung", "kranzniederlegung", "gedenken", "andacht", "requiem", "messe")),
    ("konzert", ("konzert", "musik", "chor", "orgel")),
    ("lesung", ("lesung", "buchvorstellung")),
    ("vortrag", ("vortrag", "referat", "podium", "diskussion", "kolloquium", "symposium", "tagung")),
    ("begleitung", ("sterbebegleitung", "trauerbegleitung", "trauercafé", "trauercafe", "letzte hilfe", "hospiz", "austausch", "gesprächstisch", "gespraechstisch")),
    ("fuehrung", ("führung", "fuehrung", "rundgang", "spaziergang", "rundfahrt", "busrundfahrt", "fahrradtour", "exkursion", "tour")),
    (
        "aktionstag",
        (
            "tag des friedhofs", "tag des offenen denkmals", "tag des denkmals", "museumsnacht", "lange nacht", "museumstag", "aktionstag", "aktionswoche", "sommerfest",
            "kleinmesse", "fachmesse", "publikumsmesse", "informationsmesse", "infomesse", "bestattermesse", "messetag",
        ),
    ),
)

# What the buttons of types and regions say.
TYPE_LABELS = {
    "fuehrung": "F&uuml;hrungen", "aktionstag": "Aktionstage", "konzert": "Konzerte &amp; Musik", "ausstellung": "Ausstellungen", "vortrag": "Vortr&auml;ge",
    "lesung": "Lesungen", "gottesdienst": "Gedenken", "workshop": "Kurse &amp; Workshops", "begleitung": "Trauer &amp; Begleitung", "film": "Film",
}
REGION_LABELS = {
    "berlin-brandenburg": "Berlin &amp; Brandenburg", "nord": "Norden", "west": "Westen", "ost": "Osten", "sued": "S&uuml;den", "ausland": "AT / CH / CZ", "online": "Online",
}

# Regions in order of priority, with the words that name them in a place or a host.
REGIONS = (
    ("berlin-brandenburg", (
        "berlin", "stahnsdorf", "potsdam", "brandenburg", "weißensee", "weissensee", "liesenstraße", "liesenstrasse", "neukölln", "pankow", "hellersdorf", "spandau",
        "charlottenburg", "kreuzberg", "eberswalde", "neuzelle", "halbe", "hallesch", "matthäus", "dorotheenstädtisch", "dreifaltigkeit", "heerstraße", "friedrichswerdersch",
        "invalidenfriedhof", "garnisonfriedhof", "südwestkirchhof",
    )),
    ("nord", (
        "hamburg", "ohlsdorf", "kiel", "bremen", "lübeck", "luebeck", "schwerin", "hannover", "braunschweig", "doberan", "gottorf", "niedersachsen", "holstein", "mecklenburg",
        "schleswig", "flensburg", "rostock",
    )),
    ("west", (
        "köln", "koeln", "melaten", "frankfurt", "herne", "bonn", "düsseldorf", "duesseldorf", "münster", "muenster", "kassel", "xanten", "essen", "aachen", "mainz",
        "wiesbaden", "darmstadt", "trier", "speyer", "worms", "oppenheim", "saarbrücken", "osnabrück", "osnabrueck", "düren", "dueren", "siegen", "paderborn", "saarbruecken",
        "saarland", "nordrhein", "westfalen", "rheinland", "nrw", "pfalz", "dortmund", "bochum", "wuppertal", "duisburg", "oberhausen", "gelsenkirchen", "krefeld", "hagen",
        "bielefeld", "mönchengladbach", "moenchengladbach", "leverkusen", "solingen", "sepulkralmuseum",
    )),
    ("ost", (
        "leipzig", "dresden", "halle saale", "erfurt", "magdeburg", "naumburg", "sachsen", "thüringen", "thueringen", "anhalt", "chemnitz", "quedlinburg", "striesener",
        "eliasfriedhof", "görlitz", "goerlitz", "weimar", "jena",
    )),
    ("sued", (
        "münchen", "muenchen", "nürnberg", "nuernberg", "regensburg", "augsburg", "stuttgart", "ulm", "bamberg", "würzburg", "wuerzburg", "passau", "karlsruhe", "freiburg",
        "chammünster", "chammuenster", "bayern", "schwaben", "heidelberg", "tübingen", "tuebingen", "ingolstadt", "dmm-ingolstadt", "epitaphienkultur", "greding", "finsterau",
        "massing", "niederbayern", "freyung", "grafenau", "fürth", "fuerth", "erlangen", "mannheim", "konstanz", "baden",
    )),
    ("ausland", (
        "wien", "salzburg", "innsbruck", "graz", "admont", "hallstatt", "basel", "bern", "zürich", "zuerich", "st. gallen", "st.gallen", "luzern", "genf", "prag", "praha",
        "kutná hora", "kutna hora", "sedlec", "brno", "brünn", "bruenn", "österreich", "oesterreich", "schweiz", "tschechien", "kaisergruft", "kapuzinergruft",
        "friedhoefewien", "bestattungwien", "linz", "barbarafriedhof", "linzag", "kulturfuchs", "klagenfurt", "winterthur", "biel", "chur",
    )),
)
ONLINE_WORDS = ("online", "bundesweit")

# Words of venues.
VENUES = (
    "friedhof", "friedhöf", "friedhoef", "kirchhof", "kirchhöf", "kirchhoef", "beinhaus", "krematorium", "hospiz", "kolumbarium", "gruft", "grüfte", "gruefte",
    "aussegnungshalle", "trauerhalle", "palliativ", "katakombe", "sepulkralmuseum", "bestattungsmuseum", "friedhofforum", "epitaph", "volksbund", "kriegsgräber",
    "kriegsgraeber", "trauer",
)

# Patterns of topics.
TOPICS = (
    "friedhof", "friedhöf", "kirchhof", "kirchhöf", "grabstätte", "grabmal", "grabkunst", "grabstein", "grabdenkmal", "grabanlage", "grabkammer", "grabschatz", "grabschätze",
    "grabes", "grabfund", "grablege", "ehrengrab", "ehrengräb", r"\bgrab\b", r"\bgräber", r"\bgrabe\b", r"\bgräbern", "gruft", "grüfte", "mausoleum", "mausoleen",
    "beinhaus", "ossuar", "kolumbarium", "urnen", r"\bsarg", r"\bsärge", r"\bsarko", "bestattung", "begräbnis", "beisetzung", "sepulkral", "sepulchral", "epitaph",
    "krematorium", "feuerbestattung", "erdbestattung", "einäscherung", "trauer", "hinterbliebene", "kondolenz", "beileid", "sterbebegleitung", "sterbende", r"\bsterben",
    r"\bsterbe", "hospiz", "palliativ", r"\bverstorben", r"\bverstarb", r"\btod", r"\btote", r"\btoten", r"\btotes", "totengedenk", "totentanz", "volkstrauertag",
    "ewigkeitssonntag", "totensonntag", "allerheiligen", "allerseelen", "requiem", "seelenmesse", "gedenkkultur", "gedenkfeier", "gedenkveranstaltung", "kranzniederlegung",
    "mumie", "mumien", "skelett", "gebeine", r"\bknochen", "vergänglichkeit", r"memento\s+mori", "vanitas", "jenseits", "nachlass", "kriegsgräber", r"\bgefallenen",
    "mahnmal", "ehrenmal", "holocaust", "schoah", r"\bleichen", "aufbahrung", "aussegnung", "leichenwagen", "leichenzug", "leichenschmaus", "leichenhalle", "totenbrett",
    "totenwache", "totentoilette", "totenglocke", "sterbekultur", "abschiedskultur", "grabbeigabe", "totenkult", "ruhestätte", "ruhestätten", "nekropol", "katakombe",
    "bestattungsvorsorge", "vorsorgeplanung", "vorsorgevollmacht", "patientenverfügung", "patientenverfuegung", "letztwillig", "lebensende", r"letzte\s+hilfe", "vermächtnis",
    "vermaechtnis", r"\bgestorben", r"\bverwaist", r"\bwaisen", "sternenkind", "totgeburt", "fehlgeburt", r"\bverwitwet", "hinterlassenschaft", "präparat", "praeparat",
    "obduktion", "pathologisch", r"\bsezier", "einbalsamier", "moulage", "sterblichkeit", "endlichkeit", "abschiednehmen", "trauerrede", "grabrede", "urnenhain", "friedwald",
    "ruheforst", "gedenkstein", r"\bwiedergänger", r"\breliquie", "anatomisch", r"\banatomie", "seelenheil", "fegefeuer", r"\bhinrichtung", r"\bmassengrab",
    r"\bmassengräber", "kannibal", "einbalsam", "leichnam",
)

# What a title of one person's funeral begins with.
FUNERAL_PREFIXES = ("urnen", "erd", "feuer", "see", "baum")
FUNERAL_WORDS = ("beisetzung", "bestattung", "trauerfeier", "beerdigung", "trauerandacht", "aussegnung")

# Generator names and the suffix under which their calendars lie.
GENERATOR_FEEDS = (("the events calendar", "?ical=1"), ("events calendar", "?ical=1"))
GENERATOR_HINT = "tribe-events"
