"""Word lists of the product-name heuristic, kept as plain text."""

from __future__ import annotations


# Animal keywords of product names, in rank order.
ANIMAL_WORDS = """
crema de leche, clara de huevo, suero de leche, extracto de carne, caldo de carne,
caldo de ave, manteca de cerdo, grasa vacuna, grasa porcina, dulce de leche, leche,
manteca, mantequilla, nata, queso, yogur, yoghurt, huevo, huevos, yema, miel,
gelatina, caseina, caseinato, lactosa, colageno, sebo, carmin, cochinilla, e120,
jamon, panceta, tocino, pollo, carne, pescado, atun, merluza, salmon, anchoa,
camaron, langostino, marisco, chorizo, salchicha, ternera, cordero, cabrito,
conejo, pavo, pato, codorniz, morcilla, salame, salamin, mortadela, bondiola,
matambre, higado, molleja, chinchulin, menudencias, achuras, mondongo,
oleomargarina, lisozima, mejillon, mejillones, ostra, vieira, pulpo, calamar,
crustaceo, crustaceos, trucha, corvina, lenguado, caballa, sardina, surimi, helado,
flan, postre, mousse, budin, bizcochuelo, torta, alfajor, brownie, cheesecake,
mayonesa, crema, whey, milk, cheese, butter, cream, egg, eggs, honey, gelatin,
gelatine, collagen, beef, pork, chicken, bacon, ham, fish, tuna, shrimp, lard,
casein, lactose, yogurt, veal, lamb, poultry, turkey, buttermilk, ghee, milkfat
"""

# The English keywords, whose modifier stands before the noun.
ANIMAL_WORDS_EN = """
whey, milk, cheese, butter, cream, egg, eggs, honey, gelatin, gelatine, collagen,
beef, pork, chicken, bacon, ham, fish, tuna, shrimp, lard, casein, lactose, yogurt,
veal, lamb, poultry, turkey, buttermilk, ghee, milkfat
"""

# Modifiers that neutralise one keyword only, keyword ; modifiers.
OWN_MODIFIERS = """
miel ; cana, maple, arce, agave, palma, maiz, abedul
honey ; cane, maple, agave
cream ; tartar
crema ; tartaro
"""

# Preparations that usually hold dairy or egg.
DAIRY_PREPARATIONS = """
helado, flan, postre, mousse, budin, bizcochuelo, torta, alfajor, brownie,
cheesecake, mayonesa
"""

# Modifiers that neutralise an animal keyword, in rank order.
PLANT_MODIFIERS = """
coco, almendra, almendras, soja, soya, avena, arroz, quinoa, quinua,
castana de caju, caju, girasol, sesamo, mani, garbanzo, vegetal, vegetales, vegano,
vegana, plant, base de plantas, anacardo, avellana, nuez, nueces, almond, coconut,
soy, oat, cashew, peanut, hazelnut, vegan, vegetable, pea, hemp
"""

# Explicit claims, in rank order.
VEGAN_CLAIMS = """
vegano, vegana, veganos, veganas, vegan, plant based, 100% vegetal, apto vegano,
base de plantas
"""

# Products that are a plant or a mineral.
COMMODITIES = """
agua, agua mineral, soda, sal, sal fina, sal gruesa, sal marina, bicarbonato,
azucar, harina, semola, polenta, almidon, fecula, salvado, levadura, arroz, avena,
quinoa, cebada, trigo, maiz, garbanzo, garbanzos, chickpeas, lenteja, lentejas,
poroto, porotos, arveja, arvejas, soja, yerba, yerba mate, te, cafe, aceite,
aceite de oliva, aceite de girasol, aceite de maiz, vinagre, tomate,
pure de tomate, choclo, palmito, aceituna, aceitunas, espinaca, acelga, brocoli,
zanahoria, papa, papas, batata, cebolla, zapallo, chaucha, lechuga, morron,
berenjena, zucchini, manzana, banana, naranja, mandarina, pera, uva, durazno,
ciruela, higo, datil, pasas de uva, limon, mani, almendra, almendras, nuez, nueces,
castana, caju, anacardo, avellana, pistacho, semillas, chia, lino, sesamo, girasol,
canela, comino, oregano, pimienta, pimenton, laurel, nuez moscada, curcuma,
jengibre, perejil, albahaca, romero, tomillo, curry, aji molido, clavo de olor,
pure de tomate, tomate triturado, tomate perita, mermelada
"""

# Section fragments of animal origin, in rank order.
ANIMAL_SECTIONS = """
carnes, carniceria, fiambres, embutidos, lacteos, lacteo, huevos, pescaderia,
pescados y mariscos, quesos
"""

# Section fragments of plant origin, in rank order.
PLANT_SECTIONS = """
legumbres secas, frutas y verduras frescas, frutas y verduras, verduleria, harinas
"""

# Filler words skipped before the head of a name.
FILLERS = """
de, del, la, el, los, las, con, sin, y, al, en, x, un, una
"""

# Fixed value: the "made of" phrase of a name.
BASE_PHRASE = r"\b(?:de|a base de|con)\s+([a-z]+(?: de [a-z]+)?)"

# Words looked at after a keyword, and before an English one.
WORDS_AFTER = 3
WORDS_BEFORE = 2
