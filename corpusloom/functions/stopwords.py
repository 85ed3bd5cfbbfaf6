"""Stop-words of the tokeniser."""

# The words that must be left out for equal results, in their usual order.
SPANISH = tuple(
    """
a al algo algunas alguno algunos algún ante antes aquel aquella aquellas aquellos aquí así aunque bien bueno
cada casi como con contra cosas creo cual cuando da de del desde donde dos el ella ellas ellos en entre era
esa esas ese eso esos esta estado estar estas este esto estos estoy fue fuera fueron ha hace hacen hacer hacia
hay he hecho iba ir la las le les lo los más me mejor menos mi mí mientras mismo mucho muy nada ni no nos
nosotros nuestro nuestra nuestros nuestras nueva nuevo o otra otras otro otros para parece parte pero poco
poder por porque primera primero puede pueden puedo pues que qué quién quienes se sea según ser será si sí
sido siempre sin sino sobre somos son soy su sus también tan tanto te tenemos tener tengo ti tiempo tiene
tienen toda todavía todo todos tres tú tu tus un una unas uno unos usted ustedes va vamos varios veces ver vez
ya yo
""".split()
)

# The words that must be left out for equal results, in their usual order.
ENGLISH = tuple(
    """
a about above after again against all am an and any are as at be because been before being below between both
but by can could did do does doing down during each few for from further get got had has have having he her
here hers herself him himself his how i if in into is it its itself just let like make me might more most must
my myself no nor not now of off on once only or other our ours ourselves out over own quite rather really said
same she should so some still such take than that the their theirs them themselves then there these they this
those through to too under until up us very want was we were what when where which while who whom why will
with would you your yours yourself yourselves
""".split()
)

STOPWORDS = tuple(dict.fromkeys(SPANISH + ENGLISH))


def load(path: str) -> set[str]:
    """Stop-words from a file, one a line, trimmed and lower-cased."""
    with open(path, encoding="utf-8") as f:
        return {w for line in f if (w := line.strip().lower())}
