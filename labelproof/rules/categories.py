"""Category rules, kept as plain text; the order of the lines is the rank."""

from __future__ import annotations

OTHER = "Otros"

# Category ; tag fragments.
TAG_RULES = """
Bebidas vegetales ; plant-based-beverages, plant-based-milk, soy-milks, almond-milks, vegetable-milks
Lácteos ; dairies, milks, yogurts, cheeses, creams, fermented-milk, dairy-desserts, butters, dulce-de-leche
Carnes y fiambres ; meats, meat-, hams, sausages, poultry, charcuteries, prepared-meats, beef, pork, chicken
Pescados y mariscos ; fishes, seafood, canned-fish, tuna, shellfish, sardines
Huevos ; eggs
Postres y helados ; ice-cream, frozen-desserts, desserts, flans, puddings
Golosinas y chocolates ; confectioneries, chocolates, candies, alfajores, cocoa, sweets, bonbons, chewing-gum, caramels
Galletitas y bizcochos ; biscuits, crackers, cakes, cookies, wafers
Panificados ; breads, pastries, viennoiserie, buns, toasts
Snacks salados ; salty-snacks, chips, crisps, appetizers, popcorn, extruded
Infusiones ; coffees, teas, yerba, mate, herbal-tea, hot-beverages
Bebidas alcohólicas ; alcoholic, beers, wines, spirits, ciders
Bebidas sin alcohol ; beverages, sodas, carbonated, juices, waters, syrups, iced-tea, energy-drinks
Aceites y grasas ; oils, fats, olive-oil, margarine, vegetable-oils
Azúcar y endulzantes ; sugars, table-sugar
Salsas y condimentos ; sauces, condiments, spices, seasonings, vinegars, mayonnaise, ketchup, mustard, salt, herbs
Untables y mermeladas ; spreads, jams, marmalades, honeys, nut-butters, hazelnut-spreads
Conservas ; canned, preserves, pickles, olives
Congelados ; frozen
Frutas y verduras ; fruits, vegetables, legumes-and-derivatives, nuts, dried-fruits, seeds
Cereales, pastas y legumbres ; cereals, pastas, rice, flours, legumes, breakfast-cereals, grains, noodles, semolina
Comidas preparadas ; meals, pizzas, sandwiches, soups, prepared-, empanadas
Suplementos y dietéticos ; dietary-supplements, specific-diets, baby-foods, meal-replacement, protein-, sports-
"""

# Fixed value: words that mark a plant-based product.
PLANT_BASED = (
    r"vegana?s?|vegetariana?s?|vegetal(?:es)?|plant\s*based|de\s+soja|"
    r"a\s+base\s+de\s+soja|de\s+almendras?|de\s+castanas?|de\s+arroz|"
    r"de\s+avena|de\s+coco|not\s*\w+|sin\s+tacc\s*vegana?"
)

# Category ; pattern on the product name (after a word border).
NAME_RULES = r"""
Bebidas vegetales ; leche\s+(?:de\s+)?(?:almendra|soja|coco|arroz|avena|castana|quinoa|mani)|bebida\s+(?:vegetal|de\s+almendra|de\s+soja|de\s+arroz|de\s+avena|de\s+coco)|leche\s+vegetal|alimento\s+a\s+base\s+de\s+soja
Bebidas alcohólicas ; ^(?:licor|vino|gin|vodka|whisky|whiskey|ron|fernet|aperitivo|espumante|champagne|sidra|cerveza|tequila)\b
Salsas y condimentos ; ^(?:vinagre|aceto|salsa)\b
Lácteos ; ^dulce\s+de\s+leche\b
Comidas preparadas ; (?:milanesas?|hamburguesas?|medallones?|nuggets?|salchichas?|chorizos?|fiambres?|bastones?)\s+(?:de\s+|a\s+base\s+de\s+)?(?:soja|vegetal(?:es)?|vegana?s?|seitan|legumbres|garbanzo|lenteja)|not\s*(?:burger|chicken|meat|milanesa|pollo)
Golosinas y chocolates ; huevo[s]?\s+de\s+pascua|conejo\s+de\s+chocolate
Galletitas y bizcochos ; galletit|galleta|bizcoch|cracker|vainillas|chocolinas|coquitas|hogarenas|mellizas|criollitas|polvorita|tostada|grisin|bay\s*biscuit|sonrisas|merengada|pepas|scons|(?<!dona )magdalena|budin|bizcochuelo|pan\s+dulce|budines|obleas?
Golosinas y chocolates ; alfajor|chocolate|bombon|caramelo|chupetin|chicle|gomitas?|turron|mantecol|marroc|garrapinada|jelly\s*bean|halls|beldent|milka|cofler|cadbury|confite|tita|rhodesia|bon\s*o\s*bon|nugaton|mentita|golosina|barra\s+de\s+cereal|pastillas?\s+de|dulce\s+de\s+batata|dulce\s+de\s+membrillo|gatitos|shot\b
Postres y helados ; helado|postre|flan|gelatina|mousse|chantilly|cassata|bombon\s+helado|palito\s+helado
Infusiones ; \bcafe\b|cappuccino|capuchino|yerba|mate\s+cocido|\bte\b|te\s+(?:verde|negro|rojo|en\s+saquitos)|tisana|nescafe|cafe\s+instantaneo|saquitos\s+de\s+te|torrado
Snacks salados ; snack|papas\s+fritas|palitos|chizitos|nachos|takis|saladix|pochoclo|pop\s*corn|conitos|doritos|cheetos|mani\s+(?:salado|tostado)|chips\s+de|papa\s+frita|tostaditas|bastoncitos
Pescados y mariscos ; \batun\b|caballa|sardina|merluza|salmon|anchoa|calamar|langostino|camaron|mejillon|surimi|filet\s+de\s+pescado
Bebidas alcohólicas ; \bvino\b|(?<!levadura de )cerveza|fernet|whisky|whiskey|vodka|\bgin\b|\bron\b|aperitivo|champagne|espumante|sidra|licor|malbec|cabernet|tequila|vermouth|\bcava\b
Bebidas sin alcohol ; gaseosa|\bagua\b|\bjugo\b|\bsoda\b|coca\s*cola|pepsi|sprite|fanta|seven\s*up|7\s*up|agua\s+saborizada|isotonic|energizante|exprimido|nectar|tonica|limonada|amargo\s+serrano|bebida\s+cola
Azúcar y endulzantes ; azucar|edulcorante|stevia|sacarina|endulzante|sucralosa|jarabe\s+de\s+maiz
Aceites y grasas ; aceite|margarina|oleomargarina|rocio\s+vegetal|grasa\s+(?:bovina|vacuna)|manteca\s+de\s+cerdo
Untables y mermeladas ; mermelada|jalea|\bmiel\b|pasta\s+de\s+mani|mantequilla\s+de\s+mani|nutella|crema\s+de\s+avellana|untable\s+dulce
Salsas y condimentos ; mayonesa|ketchup|mostaza|\bsalsa\b|pure\s+de\s+tomate|tomate\s+(?:triturado|perita|cubeteado)|aderezo|vinagre|condimento|oregano|pimienta|canela|comino|pimenton|\bsal\s+(?:fina|gruesa|entrefina)|\bcaldo\b|aji\s+molido|\bcurry\b|laurel|provenzal|chimichurri|savora|nuez\s+moscada|azafran|especias?
Lácteos ; yogur|yoghurt|\bqueso|ricota|muzzarella|mozzarella|provolone|roquefort|dulce\s+de\s+leche|\bleche\b|\bcrema\b|\bmanteca\b|kesitas|casancrem|serenito|yogurisimo|cuajada|queso\s+untable|leche\s+(?:en\s+polvo|condensada|chocolatada)|postre\s+lacteo
Carnes y fiambres ; jamon|salame|mortadela|bondiola|panceta|chorizo|salchicha|\bcarne\b|\bpollo\b|\bcerdo\b|pechuga|\bnalga\b|\basado\b|matambre|\bpaleta\b|\blomo\b|hamburguesa|milanesa|morcilla|\bpata\s+muslo|peceto|vacio|costeleta|churrasco|bife
Panificados ; \bpan\b|pan\s+(?:lactal|rallado|de\s+molde|arabe|frances)|factura|medialuna|prepizza|tapas?\s+de\s+(?:empanada|tarta)|chipa|\bbaguette\b|panes\b|churro
Cereales, pastas y legumbres ; fideo|spaghetti|spagueti|tallarin|mostachol|ravioles?|noquis|sorrentinos|\barroz\b|harina|polenta|avena|cereal|granola|copos|lenteja|poroto|garbanzo|arveja|soja\s+texturizada|semola|quinoa|salvado|fecula|almidon|chickpeas|zucaritas|froot\s*loops|\bpastas?\b|codito|municion|tirabuzon|penne|farfalle|casereccia|fusilli|fideo|cabellos?\s+(?:de\s+)?angel|dedalito|monos\s+de\s+pasta|cintas
Huevos ; (?<!al )(?<!con )\bhuevos?\b|clara\s+de\s+huevo|\byema\b
Comidas preparadas ; pizza|sandwich|\bsopa\b|empanada|tarta\s+(?:de|salada)|canelones|lasagna|lasana|guiso|pure\s+de\s+papa|nuggets|bocaditos|comida\s+lista|plato\s+listo|rebozado
Conservas ; aceituna|palmito|\bchoclo\b|pickles|conserva|encurtido|al\s+natural\s+lata|\bescabeche\b
Frutas y verduras ; \bverduras?\b|hortaliza|lechuga|cebolla|zanahoria|zapallo|zapallito|brocoli|espinaca|acelga|champinon|\bhongos\b|\bensalada\b|pasas\s+de\s+uva|\bnuez\b|\bnueces\b|almendras\b|castanas\b|semillas?\s+de|frutos\s+secos|\bfruta\s+fresca
Suplementos y dietéticos ; proteina|\bwhey\b|suplemento|colageno|vitamina|papilla|\bnestum\b|compota|alimento\s+infantil|leche\s+de\s+formula|creatina|barrita\s+proteica
Congelados ; congelad|\bfreezer\b|ultracongelad
"""

# Shelf label ; category.
SHELF_RULES = """
lacteos ; Lácteos
lacteos y productos frescos ; Lácteos
carnes ; Carnes y fiambres
pescados y mariscos ; Pescados y mariscos
frutas y verduras ; Frutas y verduras
panaderia ; Panificados
panaderia y pasteleria ; Panificados
congelados ; Congelados
isotonicas ; Bebidas sin alcohol
aguas saborizadas ; Bebidas sin alcohol
"""

# Categories of animal origin.
ANIMAL_CATEGORIES = """
Carnes y fiambres, Lácteos, Huevos, Pescados y mariscos
"""
