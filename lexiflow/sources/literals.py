"""The literal tables of the application: what is shown, named and asked for.

Drawings are left out; a story page or a cover that is a drawing has the flag ``drawn``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import literal

# Fixed values, all tables below: names, labels, colours, boxes and texts that results depend on.

#: What is counted.
COUNT_OBJECTS = ("🐶", "🐱", "🐰", "🐻", "🦊", "🐸", "🦋", "🐝", "🌟", "🍎", "🍌", "🎈", "🐷", "🐢", "🦁")

#: Colour names and values.
COLORS = (("rouge", "#FF4D4D"), ("bleu", "#3A86FF"), ("jaune", "#FFD43B"), ("vert", "#4CAF50"), ("rose", "#FF8FAB"), ("violet", "#9D4EDD"), ("orange", "#FF8C42"))

#: Shape names and their fills.
SHAPES = (("rond", "#FF6B6B"), ("carré", "#4ECDC4"), ("triangle", "#FFD43B"), ("étoile", "#FF8FAB"), ("cœur", "#FF4D8D"))

#: Body parts: id, name, and boxes of top, left, width, height.
BODY_PARTS = (
    ("tete", "la tête", (("5%", "30%", "40%", "22%"),)),
    ("ventre", "le ventre", (("28%", "30%", "40%", "28%"),)),
    ("main", "la main", (("44%", "4%", "22%", "15%"), ("44%", "74%", "22%", "15%"))),
    ("pied", "le pied", (("77%", "18%", "26%", "15%"), ("77%", "56%", "26%", "15%"))),
    ("cou", "le cou", (("21%", "38%", "24%", "8%"),)),
    ("bras", "le bras", (("32%", "14%", "18%", "16%"), ("32%", "68%", "18%", "16%"))),
    ("jambe", "la jambe", (("57%", "28%", "20%", "18%"), ("57%", "52%", "20%", "18%"))),
    ("oreille", "l'oreille", (("12%", "25%", "16%", "12%"), ("12%", "59%", "16%", "12%"))),
    ("nez", "le nez", (("14%", "42%", "16%", "8%"),)),
    ("bouche", "la bouche", (("18%", "40%", "20%", "8%"),)),
    ("genou", "le genou", (("64%", "30%", "16%", "10%"), ("64%", "54%", "16%", "10%"))),
)

#: Body parts that must not be shown together.
CONFLICTS = {
    "tete": ("oreille", "nez", "bouche", "cou"),
    "oreille": ("tete", "nez", "bouche"),
    "nez": ("tete", "oreille", "bouche"),
    "bouche": ("tete", "oreille", "nez"),
    "cou": ("tete", "ventre"),
    "ventre": ("cou",),
    "bras": ("main",),
    "main": ("bras",),
    "jambe": ("genou", "pied"),
    "genou": ("jambe",),
    "pied": ("jambe",),
}

#: Praise after a right answer, and encouragement after a wrong one.
PRAISES = ("Bravo !", "Super !", "Excellent !", "Magnifique !", "Génial !", "Bien joué !")
ENCOURAGE = ("Essaie encore !", "Presque !", "Regarde bien !")

#: Puzzles: id, name, size.
PUZZLES = (("maison", "la maison", 400), ("visage", "le visage souriant", 400), ("voiture", "la voiture", 400), ("chat", "le chat", 400), ("poisson", "le poisson", 400), ("fusee", "la fusée", 400))

#: Balloons: emoji, name, and the sound of animals.
BALLOONS = (
    ("🐶", "le chien", "wouf wouf"), ("🐱", "le chat", "miaou miaou"), ("🐄", "la vache", "meuh meuh"), ("🦆", "le canard", "coin coin"),
    ("🐷", "le cochon", "groin groin"), ("🐔", "la poule", "cot cot codet"), ("🐸", "la grenouille", "coâ coâ"), ("🐝", "l'abeille", "bzzz bzzz"),
    ("🦁", "le lion", "rooaarrr"), ("🐴", "le cheval", "hi hi hi"), ("1️⃣", "le un", None), ("2️⃣", "le deux", None), ("3️⃣", "le trois", None),
    ("🔴", "le rond", None), ("🟦", "le carré bleu", None), ("🔺", "le triangle", None), ("⭐", "l'étoile", None), ("❤️", "le cœur", None),
    ("🍎", "la pomme", None), ("🍌", "la banane", None), ("🍓", "la fraise", None), ("🍇", "le raisin", None), ("🍐", "la poire", None),
)
BALLOON_COLORS = ("#FF6B6B", "#4ECDC4", "#FFD93C", "#95E06C", "#A06CD5", "#FF9FB5", "#5DADE2", "#FFB347")

#: Notes: name, frequency, colour. A name may occur twice; the ordinal is the note.
NOTES = (("Do", 261.63, "#FF4D4D"), ("Ré", 293.66, "#FF8C42"), ("Mi", 329.63, "#FFD43B"), ("Fa", 349.23, "#7FD85C"), ("Sol", 392.0, "#3A86FF"), ("La", 440.0, "#A06CD5"), ("Si", 493.88, "#FF6B95"), ("Do", 523.25, "#E84D4D"))

#: Families and their items.
FAMILIES = (
    ("les animaux", ("🐶", "🐱", "🐰", "🐻", "🦊", "🐸", "🐷", "🦁", "🐴", "🐔", "🐢")),
    ("les fruits", ("🍎", "🍌", "🍓", "🍇", "🍐", "🍊", "🍒", "🍉", "🍑")),
    ("les véhicules", ("🚗", "🚌", "🚂", "✈️", "🚀", "🚲", "⛵", "🚁")),
)

#: Games: id, emoji, label.
GAMES = (("count", "🔢", "Compter"), ("colors", "🎨", "Couleurs"), ("shapes", "🔷", "Formes"), ("puzzle", "🧩", "Puzzle"), ("balloons", "🎈", "Ballons"), ("body", "🧍", "Le Corps"), ("shadow", "🫥", "Les Ombres"), ("complete", "🖼️", "Complète l'image"), ("memory", "🃏", "Les Paires"), ("families", "🍎", "Les Familles"))

#: Labels of props, read aloud; DEFAULT_LABEL for others.
PROP_LABELS = {
    "🌙": "la lune", "⭐": "une étoile", "🛏️": "le lit", "🌅": "le lever du soleil", "☀️": "le soleil", "🥞": "une crêpe", "🥛": "du lait",
    "🍓": "une fraise", "🪥": "la brosse à dents", "💧": "une goutte d'eau", "🫧": "des bulles", "🌸": "une fleur", "🌼": "une fleur",
    "🦋": "un papillon", "🧥": "un manteau", "🧣": "une écharpe", "👢": "une botte", "🌳": "un arbre", "🏠": "une maison", "☁️": "un nuage",
    "🛝": "le toboggan", "⚽": "un ballon", "🌿": "de l'herbe", "💕": "des cœurs", "❓": "un point d'interrogation", "🧸": "un doudou",
    "🥿": "un chausson", "🍪": "un biscuit", "🌷": "une tulipe", "🧺": "un panier", "🥚": "un œuf", "🐛": "un ver de terre",
    "☔": "un parapluie", "🌈": "un arc-en-ciel",
}
DEFAULT_LABEL = "regarde !"

#: Labels of characters: the first whose emoji occurs; DEFAULT_CHARACTER for others.
CHARACTERS = (("🐷", "Lulu le cochon"), ("🐻", "Nounours"), ("🐱", "Mimi la chatte"), ("🦆", "les petits canards"), ("🐰", "le lapin"), ("🐥", "Pilou le poussin"), ("🐔", "Maman Poule"), ("🐘", "Bibi l'éléphant"))
DEFAULT_CHARACTER = "le personnage"

#: Accents of a new book, the accent of a book without one, and its cover.
BOOK_ACCENTS = ("#FFD93C", "#FF9FB5", "#A8D8A8", "#A8E0F0", "#D4B5E8", "#FFB07A")
DEFAULT_ACCENT, DEFAULT_COVER = "#FFD93C", "📗"

#: Stories: id, title, cover (None: a drawing), accent, and pages of scene, character, props, text (no scene: a drawing).
STORIES = (
    ("miko", "Miko et les trois fromages", None, "#FFD93C", (
        (None, None, None, "Chut ! La nuit, Miko dort dans son petit trou."),
        (None, None, None, "Oh ! Un fromage sur la table ! Miam !"),
        (None, None, None, "Encore un fromage ! Maintenant Miko en a deux."),
        (None, None, None, "Trois fromages ! Un... deux... trois !"),
        (None, None, None, "Miko partage avec ses amis. Quel beau pique-nique !"),
    )),
    ("lulu", "La journée de Lulu", "🐷", "#FF9FB5", (
        ("night", "🐷", ("🌙", "⭐", "🛏️"), "Chut ! Lulu dort dans son lit."),
        ("morning", "🐷", ("🌅", "☀️"), "Bonjour le soleil ! Lulu se réveille."),
        ("kitchen", "🐷", ("🥞", "🥛", "🍓"), "Miam ! Lulu mange une crêpe."),
        ("bathroom", "🐷", ("🪥", "💧", "🫧"), "Frotte, frotte ! Les dents bien propres."),
        ("garden", "🐷", ("🌸", "🌼", "🦋"), "Hop ! Lulu est prête pour jouer !"),
    )),
    ("nounours", "Nounours au parc", "🐻", "#A8D8A8", (
        ("room", "🐻", ("🧥", "🧣", "👢"), "Nounours met son manteau rouge."),
        ("street", "🐻", ("🌳", "🏠", "☁️"), "Un, deux, un, deux ! On va au parc."),
        ("park", "🐻", ("🛝", "🌳", "🌼"), "Youpi ! Le grand toboggan !"),
        ("park", "🐻🐰", ("⚽", "🌳"), "Coucou Lapin ! On joue ensemble ?"),
        ("evening", "🐻", ("🌅", "🏠"), "Quelle belle journée ! Nounours est content."),
    )),
    ("canards", "Les petits canards", "🦆", "#A8E0F0", (
        ("pond", "🦆", ("🌿", "💧", "☀️"), "Un petit canard sur l'eau. Coin coin !"),
        ("pond", "🦆🦆", ("🌿", "💧"), "Voilà un ami ! Maintenant ils sont deux."),
        ("pond", "🦆🦆🦆", ("🌿", "🌸"), "Encore un ! Un, deux, trois petits canards !"),
        ("pond", "🦆🦆🦆", ("💕", "☀️", "🌸"), "Trois petits canards heureux ensemble !"),
    )),
    ("mimi", "Mimi et son doudou", "🐱", "#D4B5E8", (
        ("room", "🐱", ("❓", "🧸"), "Où est mon doudou ? Mimi ne le trouve plus !"),
        ("room", "🐱", ("🛏️", "🥿"), "Sous le lit ? Non, juste un chausson."),
        ("kitchen", "🐱", ("🍪", "🥛"), "Dans la cuisine ? Non, juste un biscuit."),
        ("garden", "🐱", ("🌳", "🌷"), "Dans le jardin ? Non, juste une fleur."),
        ("room", "🐱🧸", ("💕", "🧺"), "Mon doudou ! Il était caché dans le panier !"),
    )),
    ("poussin", "Pilou le poussin", "🐥", "#FFE066", (
        ("morning", "🐥", ("🌅", "🥚"), "Cui cui ! Pilou sort de son œuf ce matin."),
        ("garden", "🐥", ("🐛", "🌼"), "Miam, un petit ver de terre pour le petit-déjeuner !"),
        ("garden", "🐥🐔", ("🌸", "🦋"), "Coucou Maman Poule ! Pilou n'est plus tout seul."),
        ("park", "🐥", ("🛝", "☁️"), "Pilou essaie de voler... pas encore, mais il court très vite !"),
        ("evening", "🐥🐔", ("🌅", "🏠"), "Le soir, Pilou rentre se blottir contre Maman Poule."),
    )),
    ("elephant", "Bibi et le grand parapluie", "🐘", "#8ECBE8", (
        ("room", "🐘", ("☔", "☁️"), "Il pleut ! Bibi cherche son parapluie."),
        ("street", "🐘", ("💧", "🏠"), "Trouvé ! Un grand parapluie tout rouge."),
        ("park", "🐘🐰", ("💧", "🌳"), "Coucou Lapin, viens vite sous mon parapluie !"),
        ("park", "🐘🐰", ("🌈", "☀️"), "La pluie s'arrête... un arc-en-ciel apparaît !"),
        ("evening", "🐘", ("🏠", "🌅"), "Bibi rentre à la maison, tout content de sa journée."),
    )),
)

BOX = "top string, left string, width string, height string"


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Every literal table by name, each with its ordinal ``ord``."""
    page = "struct<scene:string,character:string,props:array<string>,text:string,drawn:boolean>"
    return {
        "count_objects": literal(spark, COUNT_OBJECTS, "emoji string"),
        "colors": literal(spark, COLORS, "name string, value string"),
        "shapes": literal(spark, SHAPES, "name string, fill string"),
        "body_parts": literal(spark, [(i, n, [dict(zip(("top", "left", "width", "height"), b)) for b in bs]) for i, n, bs in BODY_PARTS], "id string, name string, boxes array<struct<top:string,left:string,width:string,height:string>>"),
        "conflicts": literal(spark, [(a, b) for a, bs in CONFLICTS.items() for b in bs], "src string, dst string"),
        "praises": literal(spark, PRAISES, "phrase string"),
        "encourage": literal(spark, ENCOURAGE, "phrase string"),
        "puzzles": literal(spark, PUZZLES, "id string, name string, size int"),
        "balloons": literal(spark, BALLOONS, "emoji string, name string, sound string"),
        "balloon_colors": literal(spark, BALLOON_COLORS, "value string"),
        "notes": literal(spark, NOTES, "name string, freq double, color string"),
        "families": literal(spark, [(n, list(i)) for n, i in FAMILIES], "name string, items array<string>"),
        "games": literal(spark, GAMES, "id string, emoji string, label string"),
        "prop_labels": literal(spark, list(PROP_LABELS.items()), "emoji string, label string"),
        "book_accents": literal(spark, BOOK_ACCENTS, "value string"),
        "stories": literal(spark, [(i, t, c, a, [(s, ch, list(p) if p else None, x, s is None) for s, ch, p, x in pages]) for i, t, c, a, pages in STORIES], f"id string, title string, cover string, accent string, pages array<{page}>"),
    }
