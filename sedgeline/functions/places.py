"""Fixed values of the gazetteer: names of places and what they stand for.

Countries are three-letter codes. All tables here are values that results
depend on; a user's own country names come first (see operators.gazetteer).
"""

from __future__ import annotations

#: States that are gone. Names in WEAK count only where a segment names no other country.
WEAK = ("ussr", "soviet union", "sovjet union", "czechoslovakia", "czecho slovakia", "yugoslavia")
HISTORICAL = {
    "ussr": "RUS", "soviet union": "RUS", "sovjet union": "RUS", "czechoslovakia": "CZE", "czecho slovakia": "CZE", "yugoslavia": "SRB",
    "east germany": "DEU", "west germany": "DEU", "german democratic republic": "DEU", "federal republic of germany": "DEU",
    "belgian congo": "COD", "belgain congo": "COD", "zaire": "COD", "burma": "MMR", "siam": "THA", "ceylon": "LKA", "persia": "IRN",
    "formosa": "TWN", "rhodesia": "ZWE", "upper volta": "BFA", "dahomey": "BEN", "tanganyika": "TZA", "zanzibar": "TZA",
    "roumania": "ROU", "rumania": "ROU", "new hebrides": "VUT", "dutch east indies": "IDN",
}

#: Spellings, parts of countries and towns.
VARIANTS = {
    "usa": "USA", "united states of america": "USA", "united states": "USA", "uk": "GBR", "united kingdom": "GBR", "great britain": "GBR",
    "britain": "GBR", "england": "GBR", "scotland": "GBR", "wales": "GBR", "northern ireland": "GBR", "isle of man": "GBR", "hebrides": "GBR",
    "thames": "GBR", "london": "GBR", "plymouth": "GBR", "devon": "GBR", "brittas": "IRL", "eire": "IRL",
    "russian federation": "RUS", "siberia": "RUS", "lake baikal": "RUS", "lake baical": "RUS", "kamchatka": "RUS", "karelia": "RUS",
    "kola": "RUS", "amur": "RUS", "volga": "RUS", "povolzhye": "RUS", "ural": "RUS", "sverdlovsk": "RUS", "krasnodar": "RUS",
    "chukotka": "RUS", "peterhoff": "RUS", "kirov": "RUS", "novosibirsk": "RUS", "tomsk": "RUS", "kemerovo": "RUS", "leningrad": "RUS",
    "moscow": "RUS", "st petersberg": "RUS", "st petersburg": "RUS", "mary a s s r": "RUS", "moldavia": "MDA", "vilnius": "LTU",
    "lvov": "UKR", "cernovcy": "UKR", "sevastopol": "UKR", "turkestan": "UZB", "suchomi": "GEO", "sukhumi": "GEO", "frankreich": "FRA",
    "turkiye": "TUR", "trabzon": "TUR", "ortahisar": "TUR", "ordu": "TUR", "venezeula": "VEN", "malaya": "MYS", "west malaysia": "MYS",
    "negri sembilan": "MYS", "rab island": "HRV", "amazon river": "BRA", "florianopolis": "BRA", "visakhapatnam": "IND",
    "floridia": "USA", "ascension": "SHN", "strait of georgia": "CAN", "banyuls": "FRA", "orsay": "FRA", "essonne": "FRA",
    "concarneau": "FRA", "trebon": "CZE", "chotebor": "CZE", "lednice": "CZE", "okhotsk": "RUS", "vrevo": "RUS",
    "republic of korea": "KOR", "south korea": "KOR", "north korea": "PRK", "korea": "KOR", "ivory coast": "CIV", "cote divoire": "CIV",
    "czech republic": "CZE", "czechia": "CZE", "bohemia": "CZE", "moravia": "CZE", "slovakia": "SVK", "holland": "NLD",
    "the netherlands": "NLD", "vietnam": "VNM", "viet nam": "VNM", "hong kong": "HKG", "macau": "HKG", "reunion": "FRA",
    "corsica": "FRA", "guadeloupe": "FRA", "french polynesia": "PYF", "new caledonia": "NCL", "sardinia": "ITA", "sicily": "ITA",
    "madeira": "PRT", "azores": "PRT", "canary islands": "ESP", "balearic": "ESP", "greenland": "GRL", "faroe": "DNK",
    "tasmania": "AUS", "papua new guinea": "PNG", "democratic republic of the congo": "COD", "dr congo": "COD",
    "republic of the congo": "COG", "myanmar": "MMR", "eswatini": "SWZ", "swaziland": "SWZ", "north macedonia": "MKD",
    "macedonia": "MKD", "bosnia": "BIH", "herzegovina": "BIH", "cape verde": "CPV", "cabo verde": "CPV", "ngazidja": "COM",
    "puerto rico": "PRI",
}

#: Names that mean a place in the United States where the segment names that country otherwise, too.
AMBIGUOUS_US = {"georgia": "GEO", "cornwall": "GBR"}
US_CONTEXT = ("usa", "united states")

#: Parts of countries that stand for them.
US_STATES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "hawaii", "idaho",
    "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota",
    "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york",
    "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota",
    "tennessee", "texas", "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming", "gainesville",
    "biscayne bay", "puget sound", "chesapeake bay", "cornwall", "wisconisin", "great salt lake", "cape cod", "long island sound",
)
CA_PROVINCES = (
    "nova scotia", "ontario", "quebec", "british columbia", "alberta", "manitoba", "saskatchewan", "newfoundland", "labrador",
    "new brunswick", "prince edward island", "yukon", "northwest territories", "nunavut", "vancouver island", "toronto", "montreal",
)
OTHER_SUBNATIONAL = {
    "jiangsu": "CHN", "jiangxi": "CHN", "zhejiang": "CHN", "guangdong": "CHN", "shandong": "CHN", "hubei": "CHN", "henan": "CHN",
    "hunan": "CHN", "sichuan": "CHN", "yunnan": "CHN", "chongqing": "CHN", "shenzhen": "CHN", "nanjing": "CHN", "shanghai": "CHN",
    "beijing": "CHN", "tibet": "CHN", "kerala": "IND", "assam": "IND", "andhra pradesh": "IND", "tamil nadu": "IND",
    "karnataka": "IND", "west bengal": "IND", "maharashtra": "IND", "waltair": "IND", "queensland": "AUS", "new south wales": "AUS",
    "victoria, australia": "AUS", "lower saxony": "DEU", "bavaria": "DEU", "saxony": "DEU", "brittany": "FRA", "normandy": "FRA",
    "provence": "FRA", "alsace": "FRA", "roscoff": "FRA", "montpellier": "FRA", "sao paulo": "BRA", "minas gerais": "BRA",
    "amazonia": "BRA", "rio de janeiro": "BRA", "para": "BRA", "buenos aires": "ARG", "neuquen": "ARG", "patagonia": "ARG",
    "hokkaido": "JPN", "honshu": "JPN", "kyushu": "JPN", "lake biwa": "JPN", "ibaraki": "JPN", "iwate": "JPN", "shiga": "JPN",
    "crimea": "UKR", "kiev": "UKR", "kyiv": "UKR", "tian shan": "UZB", "bukharskiy": "UZB", "panama canal": "PAN",
}

#: Open water, and the basins that water bodies belong to.
SEAS = {
    "atlantic": "Atlantic Ocean", "pacific": "Pacific Ocean", "indian ocean": "Indian Ocean", "southern ocean": "Southern Ocean",
    "antarctic ocean": "Southern Ocean", "arctic ocean": "Arctic Ocean", "mediterranean": "Mediterranean Sea", "baltic": "Baltic Sea",
    "north sea": "North Sea", "black sea": "Black Sea", "red sea": "Red Sea", "caspian": "Caspian Sea", "bay of bengal": "Bay of Bengal",
    "gulf of mexico": "Gulf of Mexico", "sea of japan": "Sea of Japan", "adriatic": "Adriatic Sea", "arabian gulf": "Persian Gulf",
    "persian gulf": "Persian Gulf", "barents sea": "Barents Sea", "bering sea": "Bering Sea", "weddell sea": "Southern Ocean",
    "white sea": "White Sea", "gulf of finland": "Baltic Sea", "finnish bay": "Baltic Sea", "finish bay": "Baltic Sea",
    "sea of azov": "Black Sea",
}
BASINS = {
    "Atlantic Ocean": "Atlantic Ocean", "Pacific Ocean": "Pacific Ocean", "Indian Ocean": "Indian Ocean", "Southern Ocean": "Southern Ocean",
    "Arctic Ocean": "Arctic Ocean", "Mediterranean Sea": "Atlantic Ocean", "Baltic Sea": "Atlantic Ocean", "North Sea": "Atlantic Ocean",
    "Black Sea": "Atlantic Ocean", "White Sea": "Arctic Ocean", "Barents Sea": "Arctic Ocean", "Red Sea": "Indian Ocean",
    "Persian Gulf": "Indian Ocean", "Bay of Bengal": "Indian Ocean", "Sea of Japan": "Pacific Ocean", "Bering Sea": "Pacific Ocean",
    "Gulf of Mexico": "Atlantic Ocean", "Adriatic Sea": "Atlantic Ocean", "Caspian Sea": "Caspian Sea", "Sea of Okhotsk": "Pacific Ocean",
}

#: Phrases without a place, in the order in which they are taken out.
NOISE = (
    "europe", "asia", "africa", "america", "north america", "south america", "central america", "west africa", "east africa", "caribbean",
    "caribbeans", "west indies", "transcaucasia", "worldwide", "cosmopolitan", "widespread", "wide spread", "tropical regions",
    "north temperate zone", "temperate", "laboratory", "lab culture", "insectary", "biological control", "unknown", "not stated",
    "not specified", "not reported", "no data", "aquarium", "commercial", "imported", "obtained", "various", "several countries",
    "multiple", "many localities",
)
#: Words that make a leftover no more informative.
FILLER = (
    "lake", "lakes", "river", "rivers", "pool", "pond", "stream", "bay", "gulf", "sea", "coast", "coastal", "island", "islands",
    "province", "region", "district", "county", "city", "town", "village", "near", "vicinity", "valley", "mountain", "mnt", "range",
    "north", "south", "east", "west", "northern", "southern", "eastern", "western", "middle", "central", "upper", "lower", "state",
    "prefecture", "territory", "strait", "straits", "sound", "inlet", "estuary", "canal", "zone", "area", "basin", "reservoir", "farm",
    "forest", "marsh", "swamp", "beach", "harbour", "harbor", "port", "and", "the", "of", "in", "at", "from", "etc", "presumably",
    "study", "isolate", "locality", "stated", "abstract", "accessible", "precise", "obtained", "collected", "samples",
)
#: Dotted abbreviations, told from words before punctuation goes.
ABBREVIATIONS = (
    (r"u\.\s?s\.\s?s\.\s?r\.?", " ussr "),
    (r"u\.\s?s\.\s?a\.?", " usa "),
    (r"u\.\s?s\.(?![a-z])", " usa "),
    (r"u\.\s?k\.?", " uk "),
    (r"a\.\s?s\.\s?s\.\s?r\.?", " russia "),
)
