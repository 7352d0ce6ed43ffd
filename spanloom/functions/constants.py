"""Code sets and patterns that results depend on."""

# Semantic types a candidate needs one of to become a mention.
SELECTED_SEMTYPES = (
    "amph anim arch bact bird euka fish fngs humn mamm plnt rept vtbt virs acab anab bpoc celc cell cgab emst "
    "ffas gngm tisu clnd sbst aapp antb bacs bodm bdsu carb chvf chvs chem eico elii enzy food hops horm imft irda inch lipd nsba nnon "
    "orch opco phsu rcpt strd vita sosy amas blor bsoj crbs mosq nusq patf comd dsyn emod mobd neop inpo"
).split()
# Semantic types that are no words of a relation label.
LABEL_SEMTYPES = (
    "aapp acab amas amph anab anim anst antb arch bacs bact bdsu bird blor bodm bpoc bsoj carb celc cell cgab chem chvf chvs clnd crbs drdd dsyn eico elii emst enzy euka ffas "
    "fish fngs food geoa gngm hops horm humn imft inch irda lipd mamm medd mnob mosq nnon nsba nusq opco orch orgm phob phsu plnt rcpt rept resd sbst sosy spco strd tisu virs vita vtbt"
).split()
# Tag patterns, to be matched whole.
VERB, NOUN, ADJECTIVE = "VB.*", "NN.*", "JJ.*"
# Fixed value: an acronym, to be matched whole.
ACRONYM = (
    r"([A-Z][A-Z0-9\-\&/]+)|([b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ][b-df-hj-np-tv-xzB-DF-HJ-NP-TV-Z0-9\-\&/]{3,})"
)
# Concept sources.
SOURCES = ("UMLS", "MESH", "JOCHEM", "UNIPROT", "DOID", "GO", "ACRONYM")


def whole(pattern: str) -> str:
    """``pattern`` as one that has to match a whole string."""
    return f"^(?:{pattern})$"
