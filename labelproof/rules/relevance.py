"""Relevance, registry and brand values."""

from __future__ import annotations

# Fixed value: scripts not used in the market (one character class).
OTHER_SCRIPTS = (
    r"[֐-׿؀-ۿݐ-ݿﭐ-﷿ﹰ-ﻼ"
    r"Ѐ-ӿԀ-ԯ԰-֏Ⴀ-ჿऀ-ॿ"
    r"฀-๿一-鿿぀-ゟ゠-ヿ가-힣]"
)

# Lengths of a real bar code.
CODE_LENGTHS = [8, 12, 13, 14]

# Words that never name a food (both word borders).
NON_FOOD_WORDS = """
shampoo, shampu, acondicionador, anticaspa, capilar, hair, tintura,
jabon, jabones, desodorante, antitranspirante, perfume, fragancia,
talco, afeitar, afeitadora, depilatoria, preservativo,
maquillaje, labial, rimel, rubor, delineador, micelar, exfoliante, serum,
facial, corporal, bronceador, esmalte,
panales, tampon, lavandina, detergente, lavavajilla, limpiavidrios,
suavizante, limpiador, desinfectante, insecticida, repelente, quitamanchas,
lustramuebles,
dentifrico, ibuprofeno, paracetamol, aspirina, antibacterial,
cigarrillo, cigarrillos, tabaco, pilas, encendedor
"""

# Phrases that never name a food (substring).
NON_FOOD_PHRASES = """
toallitas humedas, toallita humeda, papel higienico,
rollo de cocina, panuelos de papel, panuelos papel,
pasta dental, cepillo de dientes, enjuague bucal,
body lotion, gel de ducha, alcohol en gel, crema de manos,
crema para peinar, leche corporal, leche de limpieza,
protector solar, protector diario, agua micelar,
agua de colonia, panal descartable, crema dermatologica
"""

# Code ; reason, products excluded by hand.
EXCLUDED_CODES = """
7791905023623 ; alcohol en aerosol (artículo de limpieza)
7791293033198 ; antibacterial fresh Rexona (desodorante)
0650240004643 ; asepxia (dermocosmética)
7798140259459 ; asepxia Genomma (dermocosmética)
7909189091874 ; esmalte (cosmético para uñas)
2002138100001 ; esmalte para uñas Allegro (cosmético)
7793008005063 ; Issue (tintura para el cabello)
26130351000126 ; Macaroni (ficha sin marca, categoría ni ingredientes)
6260480121013 ; Manizan (crema medicinal)
7506339356939 ; Always (artículo de higiene femenina)
7791984000614 ; Oralsone Max (medicamento de venta libre)
7891150034075 ; jabón (artículo de higiene)
7790990586983 ; jabón Limol (artículo de limpieza)
77913104 ; jabón de glicerina Farmacity (cosmético)
7891010669843 ; jabón glicerinado Johnson's (cosmético)
8480017134073 ; jabón Bonté natural glycerin (cosmético)
"""

# Stems of a food branch in a shop tree.
FOOD_STEMS = """
almacen, desayuno, merienda, bebida, lacteo, queso,
fiambre, carne, pescado, marisco, fruta, verdura,
panaderia, congelado, fresco
"""

# Words without weight in the registry match.
REGISTRY_STOPWORDS = """
de, del, la, el, los, las, con, sin, y, a, al, en,
para, por, sabor, gr, grs, g, kg, ml, cc, lt, l,
x, un, una, libre, gluten, tacc, apto, producto,
untable
"""

# Start and end of a flavour clause.
FLAVOUR_START = r"\bsabor(?:es)?\b\s*(?:a\s+)?"
FLAVOUR_END = (
    r"[,.;:()/\-–—]"
    r"|\b(?:con|para|libre|sin|adicionad|fortificad|recubiert|relleno)\b"
)

# Header cells of the registry sheet.
REGISTRY_HEADERS = ["identificacion del producto", "identificacion"]

# Brand key ; spelling. The key of the apostrophe spellings has
# no gap, so both forms of that key are listed.
BRAND_ALIASES = """
aguila ; Águila
taragui ; Taragüí
nestle ; Nestlé
dia ; Día
la serenisima ; La Serenísima
sancor ; SanCor
notco ; NotCo
hellmann s ; Hellmann's
hellmanns ; Hellmann's
la campagnola ; La Campagnola
"""

# Support an accented spelling needs.
ACCENT_MIN_COUNT = 3
ACCENT_MIN_SHARE = 0.10

# Column aliases of the price file, field ; names in order.
COLUMN_ALIASES = """
ean ; producto_id, id_producto, ean, codigo_barras, productos_ean
nombre ; productos_descripcion, nombre, producto_nombre, descripcion, nombre_producto
marca ; productos_marca, marca, producto_marca
categoria ; categoria, categorias, rubro, productos_categoria
precio_ref ; productos_precio_lista, precio, precio_lista, productos_precio_unitario_promo1
"""
