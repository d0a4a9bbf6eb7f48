"""The label corrections, groups and lists the survey's results rest on."""

from __future__ import annotations

# Species label corrections by sheet year, in order.
_EARLY = [
    ("COGE", "COGO"),
    ("Caspian Tern", "CATE"),
    ("Merlin", "MERL"),
    ("GBH", "GBHE"),
    ("Peeps", "Calidris sp."),
    ("Whimbrel", "WHIM"),
    ("UNBI", "Bird sp."),
    ("BLDU", "ABDU"),
    ("Swamp Sp.", "SWSP"),
    ("N. Pintail", "NOPI"),
    ("Bonaparte’s Gull", "BOGU"),
    ("Yellow-br. Chat", "YBCH"),
    ("Co. Grackle", "COGR"),
    ("B. Oriole", "BAOR"),
    ("Snow Bunting", "SNBU"),
    ("Harlequin", "HADU"),
    ("L. Scaup", "LESC"),
    ("Tree Sparrow", "ATSP"),
    ("Am. Crow", "AMCR"),
    ("UNID", "Bird sp."),
]
_MIDDLE = [
    ("CO sp.", "Cormorant sp."),
    ("LO sp.", "Loon sp."),
    ("Great Shearwater", "GRSH"),
    ("UNBI", "Bird sp."),
    ("SC sp.", "Scoter sp."),
]
_LATE = _MIDDLE + [
    ("Duck/Alcid/Loon sp.", "Waterbird sp."),
    ("Dunlin", "DUNL"),
    ("Osprey", "OSPR"),
    ("WW Gull", "ICGU/GLGU"),
]
SPECIES_BY_YEAR = {
    2014: _EARLY,
    2015: [("Scoter Sp.", "Scoter sp.")],
    2016: [("Tree Sparrow", "ATSP")],
    2018: _MIDDLE,
    2019: _MIDDLE,
    2020: _MIDDLE,
    2021: _MIDDLE,
    2022: _MIDDLE,
    2023: _LATE,
    2024: _LATE,
}

# Labels of other animals, by sheet year.
NOT_BIRDS = {2014: ["Monarch"]}

# Corrections made after a season's rows are summed per species and day.
SPECIES_AFTER_SUM = {
    2024: [
        ("Am. Woodcock", "AMWO"),
        ("CAVE SW", "CASW"),
        ("Finch SP", "Finch sp."),
        ("Large Alcid", "Alcid sp."),
        ("Manx SH", "MASH"),
        ("SE OWL", "SEOW"),
    ],
}
SPECIES_ALL_YEARS = [
    ("Gull Sp.", "Gull sp."),
    ("Large alcid sp.", "Alcid sp."),
]

# Observer corrections of single seasons, then of the whole panel, then of the analysis.
OBSERVERS_BY_YEAR = {
    2023: [
        ("SB/BG", "BG/SB"),
        ("ND, BG", "ND/BG"),
        ("ND, SB", "ND/SB"),
        ("SB, BG, ZK", "SB/BG/ZK"),
        ("SB/ND", "ND/SB"),
    ],
    2024: [
        ("Nick Hoffmann", "NH"),
        ("Nick hoffmann", "NH"),
        ("Seth Benz", "SB"),
        ("S. Benz", "SB"),
    ],
}
OBSERVERS_ALL_YEARS = [
    ("Keith", "KO"),
    ("KO/SB?Nick", "KO/SB"),
    ("Seth", "SB"),
    (" Seth", "SB"),
    ("Andrew Wolfgang", "AW"),
    ("Seth Benz", "SB"),
    ("STB", "SB"),
    ("E. Johnson", "EJ"),
    ("S. Benz", "SB"),
    ("E Johnson", "EJ"),
    ("E Johnson/S Benz", "EJ/SB"),
    ("S Benz", "SB"),
    ("E Johnson/K Yakola", "EJ/KY"),
    ("Isabel Brofsky, Keenan Yakola", "IB/KY"),
    ("E Johnson, Isabel Brofsky, Keenan Yakola", "EJ/IB/KY"),
    ("Hallie Daly", "HD"),
    ("No Observer Available", None),
    ("Earl Johnson", "EJ"),
    ("Hallie Daly, Seth Benz", "HD/SB"),
    ("Hallie Daly, Serth Benz", "HD/SB"),
    ("Hallie Daly ", "HD"),
    ("Nathan Dubrow", "ND"),
    ("Benz/Klyver", "SB/ZK"),
    ("ZS,SB", "ZS/SB"),
    ("Ak", "AK"),
    ("", None),
    ("ACK", "AK"),
    ("A. Világ", "AV"),
    ("A Világ", "AV"),
    ("Bob D.", "BD"),
    ("RZK ", "RZK"),
    ("SS", "ZS"),
    ("RZK/STB", "RZK/SB"),
]
OBSERVERS_ANALYSIS = [
    ("SB/ZK", "SB/RZK"),
    ("RZK/SB", "SB/RZK"),
    ("STB/RZK", "SB/RZK"),
    ("ZK", "RZK"),
]

# Choices of the analysis.
SPECIES_ANALYSIS = [("SUSC/BLSC", "BLSC/SUSC")]
SKIPPED_YEARS = [2014, 2015]
SKIPPED_SPECIES = ["GBBG", "HERG"]
FOCAL_GROUP = "Seabirds"
NOT_SPECIES = [
    "Scoter sp.",
    "Cormorant sp.",
    "BLSC/SUSC",
    "Loon sp.",
    "Alcid sp.",
    "Shearwater sp.",
    "Grebe sp.",
    "TBMU/COMU",
]

# Species that stand as their own group.
OWN_GROUP = {
    "DCCO": "DC Cormorant",
    "COEI": "Common Eider",
    "COLO": "Common Loon",
    "LTDU": "LT Duck",
    "RBME": "RB Merganser",
    "WWSC": "WW Scoter",
    "BLSC": "Black Scoter",
    "SUSC": "Surf Scoter",
    "RTLO": "RT Loon",
}

# Small groups folded into larger ones for the composition report, in order.
COMPOSITION_FOLDS = [
    ("Alcids", "Other waterbirds"),
    ("Grebes", "Other waterbirds"),
    ("Raptors", "Other waterbirds"),
    ("Waterbird sp.", "Other waterbirds"),
    ("Herons", "Other waterbirds"),
    ("Jaegers", "Other waterbirds"),
    ("Shearwaters", "Other waterbirds"),
    ("Storm-Petrels", "Other waterbirds"),
    ("Shorebirds", "Other waterbirds"),
    ("Other ducks and geese", "Other ducks/geese"),
    ("Larids", "Gulls"),
]
COMPOSITION_LEVELS = [
    "Cormorants",
    "Scoters",
    "Common Eider",
    "Northern Gannet",
    "Other ducks/geese",
    "Loons",
    "Gulls",
    "Other waterbirds",
]

# Codes and scientific names of the species with a yearly trend.
TREND_NAMES = {
    "GRCO": "Phalacrocorax carbo",
    "RBME": "Mergus serrator",
    "RTLO": "Gavia stellata",
    "BLGU": "Cepphus grylle",
    "RNGR": "Podiceps grisegena",
    "DCCO": "Nannopterum auritum",
    "WWSC": "Melanitta deglandi",
    "LTDU": "Clangula hyemalis",
}
