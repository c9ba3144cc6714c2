"""Word lists and character sets."""

import string

# Fixed values.
NUMBER, CURRENCY, CHEMICAL = "num_indic", "curr_indic", "chem_indic"
STRIP = "\"#%&'();:*+-/<=>@[\\]^_`{|}~‘’“”"
PUNCTUATION = string.punctuation
SPACE = "[ \\t-\\r]+"
MARKS, NUMBER_STARTS = ".,!?;:", "+-.,0123456789ni"
PEEL = "^(?s:([.,!?;:]*)(.+?)([.,!?;:]?))$"
NUMERIC = "^[+-]?(nan|inf|infinity|([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?)$"
IPC = "([A-H][0-9]{2}[A-Z][0-9]{2,4})"
WHITE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
MIN_SENTENCE, MAX_TABLE_ROW, MIN_PARAGRAPH = 50, 100, 50
ABBREVIATIONS = (
    "u.s fig figs no ser jan feb mar apr may jun jul aug sep oct nov dec proc natl sci al biochem mol res biophys commun acad "
    "chem med biol enzymol pat nos id seq gen ed publ cell ii iii iv viral dis infect rev supp dev pp genet nucl pub etc virol "
    "ann microbiol environ curr vol enz struct exp approx int oncol appl math adv u.s.c et app biosci molec"
).split() + [str(i) for i in range(1, 40)] + list(string.ascii_lowercase)
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
