"""Ingredient lexicons: ordered rule tables kept as plain text.

One entry per line, fields separated by " ; ". The order of the lines is the
rank of the rule: inside one ingredient the first matching line decides.
Patterns apply to text that went through ``text.norm_ingredients``.
"""

from __future__ import annotations

# State ; label ; pattern. Animal ingredients, Spanish then English.
ANIMAL_TEXT = r"""
vegetariano ; leche ; \bleche(s)?\b(?! vegetal)(?!(?: \w+){0,2} de (coco|almendra|soja|soya|avena|arroz|mani|cacahuete|castana|caju|quinoa|nuez|nueces|anacardo|avellana|pistacho|macadamia|alpiste|girasol|sesamo|canamo|tigre|vegetal|origen vegetal))
vegetariano ; leche en polvo ; \bleche en polvo\b
vegetariano ; suero lácteo ; \b(suero|lactosuero|suero de leche)\b(?! de (soja|soya|vegetal))
vegetariano ; lactosa ; \blactosa\b
vegetariano ; caseína ; \bcase[ií]n(a|ato)?
vegetariano ; derivado lácteo ; \bl[aá]cte[oa]s?\b
vegetariano ; crema ; \bcrema\b(?! vegetal)(?!(?: \w+){0,2} de (coco|soja|soya|almendra|mani|cacahuete|avellana|castana|caju|anacardo|nuez|nueces|arroz|avena|girasol|sesamo|cacao|verdura|choclo|maiz|zapallo|calabaza|espinaca|tomate|hongo|champinon|arveja|lenteja|garbanzo))
vegetariano ; nata ; \bnata\b(?! vegetal| de (coco|soja|almendra))
vegetariano ; queso ; \bqueso\b(?! vegano| vegetal)(?!(?: \w+){0,2} de (almendra|castana|caju|anacardo|soja|soya|coco|nuez|nueces))
vegetariano ; ricota ; \bricota\b(?! vegana| vegetal| de (almendra|soja|caju))
vegetariano ; yogur ; \byog(ur|hurt|urt)\b(?! vegano| vegetal)(?!(?: \w+){0,2} de (coco|soja|soya|almendra|avena|anacardo|caju|castana))
vegetariano ; manteca ; \bmante(ca|quilla)\b(?! vegetal| vegana)(?!(?: \w+){0,2} de (mani|cacahuete|cacao|coco|almendra|castana|caju|anacardo|nuez|nueces|avellana|pistacho|semillas|girasol|sesamo|karite|murumuru|cupuacu))
vegetariano ; grasa butírica ; \bgrasa but[ií]rica\b|\bbutter ?oil\b
vegetariano ; dulce de leche ; \bdulce de leche\b
vegetariano ; kéfir ; \bkefir\b(?! de agua| vegetal| de coco)
no_apto ; cuajo (enzima animal) ; \bcuajo\b(?! vegetal| vegetariano| microbiano| microbiologico| de cardo| de higuera)
vegetariano ; huevo ; \bhuevo?s?\b
vegetariano ; huevo ; \b(clara|yema)s? de huevo\b
vegetariano ; derivado de huevo ; \bovo(albumina|producto)
vegetariano ; albúmina ; \balb[uú]mina\b
vegetariano ; lecitina de huevo ; \blecitina de huevo\b|\bins 322 de huevo\b
vegetariano ; lisozima (clara de huevo) ; \blisozima\b|\bins 1105\b|\be ?1105\b
vegetariano ; miel ; \bmiel\b(?! de (cana|maple|arce|agave|palma|maiz|abedul|dat[ie]l|manzana|coco))
vegetariano ; jalea real ; \bjalea real\b
vegetariano ; propóleo ; \bpropoleo\b
vegetariano ; cera de abejas ; \bcera de abejas?\b|\bins 901\b|\be ?901\b
no_apto ; gelatina ; \bgelatina\b(?! vegetal| vegana| de (algas?|agar))|\bins 441\b|\be ?441\b
no_apto ; colágeno ; \bcol[aá]geno\b(?! vegetal| vegano)
no_apto ; carne ; \bcarne\b(?! vegetal| vegana| de (soja|soya|garbanzo|arveja|trigo|lenteja|coco|seitan|hongo|champinon))|\bextracto de carne\b
no_apto ; grasa animal ; \bgrasa (bovina|vacuna|porcina|animal|ovina|de cerdo|de vaca|de ave|de aves|de pollo|de oveja|de cordero|de pella)\b
no_apto ; oleomargarina (grasa bovina u ovina, CAA art. 545) ; \boleomargarina\b
no_apto ; oleoestearina (grasa bovina u ovina, CAA art. 547) ; \boleoestearina\b
no_apto ; sebo ; \bsebo\b(?! vegetal)
no_apto ; manteca de cerdo ; \bmanteca de cerdo\b|\bchicharron
no_apto ; carne ; \b(pollo|cerdo|vacuno|bovino|porcino|jamon|panceta|tocino|chorizo|ternera|cordero|cabrito|conejo|pavo|pato|codorniz)\b(?! vegetal| vegano| de soja)
no_apto ; carne o menudencia ; \bave(s)?\b(?! de corral vegana)|\bmenudencias?\b|\bvisceras?\b|\bmondongo\b|\bh[ií]gado\b
no_apto ; carne vacuna ; \b(carne|grasa|caldo|extracto|sabor|higado|menudencia) de res\b|\bsabor res\b
no_apto ; pescado o marisco ; \b(pescado|atun|merluza|salmon|anchoa|sardina|camaron|langostino|marisco|calamar|crustaceos?|molusco|mejillon|ostra|vieira|pulpo|krill|caracol|surimi)\b(?! vegetal| vegano| de soja)
no_apto ; aceite de pescado ; \baceite de pescado\b|\bomega ?3 de pescado\b
no_apto ; caldo de origen animal ; \bcaldo de (carne|ave|pollo|pescado|hueso)\b
no_apto ; proteína animal ; \bproteina animal\b|\bproteinas animales\b
no_apto ; derivado de hueso ; \bfosfato de hueso\b|\bins 542\b|\be ?542\b|\b(harina|polvo|carbon|extracto|gelatina) de huesos?\b
no_apto ; pepsina (estómago porcino) ; \bpepsina\b
no_apto ; carmín (cochinilla) ; \bcarmin\b|\bcochinilla\b|\bins 120\b|\be ?120\b|\bacido carminico\b
no_apto ; goma laca ; \bgoma laca\b|\bshellac\b|\bins 904\b|\be ?904\b
no_apto ; carmín (cochinilla) ; \bcarmine\b|\bcochineal\b|\bcarminic acid\b
no_apto ; goma laca ; \bshellac\b
no_apto ; gelatina ; \bgelatine?\b
no_apto ; grasa animal ; \btallow\b|\blard\b|\bsuet\b
vegetariano ; suero lácteo ; \bwhey\b
vegetariano ; caseína ; \bcasein(ate)?\b
vegetariano ; derivado lácteo ; \bmilkfat\b|\bbutterfat\b|\bbuttermilk\b|\bghee\b
vegetariano ; lisozima (clara de huevo) ; \blysozyme\b
no_apto ; carne ; \b(veal|lamb|poultry|turkey|venison)\b
no_apto ; pescado o marisco ; \b(crustacean|mollusc|mussel|oyster|squid|octopus|krill)\b
no_apto ; derivado de hueso ; \bbone (meal|powder|char|broth)\b
no_apto ; derivado animal ; \banimal (fat|protein)\b
no_apto ; oleomargarina (grasa bovina u ovina) ; \boleomargarine\b
"""

# Label ; pattern. Ingredients of undeclared origin, Spanish then English.
AMBIGUOUS_TEXT = r"""
INS 471 (mono y diglicéridos): puede ser de grasa animal o vegetal ; \bins 471\b|\be ?471\b|\bmono ?y ?diglic[eé]ridos\b|\bmonogliceridos\b
INS 472: puede derivar de grasa animal o vegetal ; \bins 472\b|\be ?472
ácidos grasos / estearatos: pueden ser de sebo animal ; \bins 570\b|\bacido (estearico|oleico|palmitico|laurico|miristico)\b|\bestearato\b
polisorbatos y ésteres de sorbitán: derivan de ácidos grasos que pueden ser animales ; \bins 4(3[2-6]|9[1-5])\b|\bpolisorbato\b|\bmonoestearato de sorbitan\b|\bsorbitan\b
margarina sin aclarar: el CAA (art. 551) permite grasa animal y hasta 5% de grasa de leche ; \bmargarina\b(?! vegetal| vegana)
grasa hidrogenada sin aclarar el origen: el CAA (art. 548) admite hidrogenar grasas animales ; \bgrasa (parcialmente )?hidrogenada\b|\baceite (parcialmente )?hidrogenado\b
transglutaminasa: puede ser microbiana o de plasma animal ; \btransglutaminasa\b
nisina: se cultiva habitualmente sobre un medio lácteo ; \bnisina\b|\bins 234\b
lipasas y proteasas: pueden ser de origen animal ; \blipasa\b|\bproteasa\b
inosinato/guanilato: suelen obtenerse de pescado o carne ; \bins 631\b|\binosinato\b|\bins 627\b|\bguanilato\b
L-cisteína: puede provenir de plumas o pelo ; \bins 920\b|\bl-?cisteina\b
lecitina sin origen declarado (suele ser de soja, pero no está aclarado) ; \blecitina\b(?! de (soja|soya|girasol))|\bins 322\b|\be ?322\b
aroma natural sin origen declarado ; \baroma(s|tizante)? natural(es)?\b
saborizante natural sin origen declarado ; \bsaborizante(s)? natural(es)?\b
vitamina D3: suele venir de lanolina ; \bvitamina d3?\b|\bcolecalciferol\b
glicerina: puede ser animal o vegetal ; \bglicerina\b|\bglicerol\b|\bins 422\b
fermentos de origen no declarado ; \bfermento(s)?\b|\bcultivos? l[aá]ctico
enzimas de origen no declarado ; \benzimas?\b
azúcar refinada: puede filtrarse con carbón de hueso ; \bazucar\b.*\brefinad
aroma natural sin origen declarado ; \bnatural (flavou?r|flavou?ring)s?\b|\bflavou?ring\b
lecitina sin origen declarado (suele ser de soja, pero no está aclarado) ; (?<!soy )(?<!soya )(?<!sunflower )(?<!rapeseed )\blecithin\b
mono y diglicéridos: pueden ser de grasa animal o vegetal ; \bmono ?and ?diglycerides\b|\bmonoglycerides\b|\bdiglycerides\b
glicerina: puede ser animal o vegetal ; \bglycerin[e]?\b|\bglycerol\b
ácido esteárico: puede ser de sebo animal ; \bstearic acid\b|\bstearate\b
vitamina D3: suele venir de lanolina ; \bvitamin d3?\b|\bcholecalciferol\b
shortening sin origen declarado: puede ser grasa de cerdo ; (?<!vegetable )(?<!palm )\bshortening\b
enzimas de origen no declarado ; \benzymes?\b
"""

# Plant, mineral and synthetic ingredients, Spanish; one pattern per line.
PLANT_ES_TEXT = r"""
\bagua\b
\bazucar\b
\bsal\b
\bharina
\btrigo\b
\bmaiz\b
\barroz\b
\bavena\b
\bcebada\b
\bcenteno\b
\bquinoa\b
\bsoja\b
\bsoya\b
\bgarbanzo
\blenteja
\bporoto
\barveja
\bmani\b
\balmendra
\bnuez\b
\bnueces\b
\bcastana
\bcaju\b
\banacardo
\bavellana
\bpistacho
\bsemillas?\b
\bgirasol\b
\bsesamo\b
\bchia\b
\blino\b
\baceite vegetal\b
\baceite de (girasol|maiz|soja|oliva|canola|algodon|palma|coco)\b
\bgrasa vegetal\b
\bmargarina vegetal\b
\bcacao\b
\bchocolate\b
\bcafe\b
\bte\b
\byerba\b
\bfrutas?\b
\bverduras?\b
\btomate
\bpapa\b
\bcebolla\b
\bajo\b
\bmorron
\bzanahoria
\bespinaca
\bnaranja
\blimon\b
\bmanzana
\bbanana
\bfrutilla
\bdurazno
\bpera\b
\buva\b
\baceituna
\bpalta\b
\bcoco\b
\bvainilla\b
\bcanela\b
\bpimienta\b
\boregano\b
\bcomino\b
\bperejil\b
\balbahaca\b
\bvinagre\b
\balcohol\b
\bmalta\b
\blevadura\b
\balmidon
\bfecula
\bglucosa\b
\bfructosa\b
\bdextrosa\b
\bjarabe\b
\bmaltodextrina\b
\bgoma (xantica|guar|arabiga|garrofin)\b
\bpectina\b
\bcarragenina\b
\bagar\b
\bcelulosa\b
\bacido (citrico|ascorbico|malico|tartarico|lactico|folico|fosforico)\b
\bcitrato\b
\bbicarbonato\b
\bcarbonato\b
\bsulfato\b
\bfosfato de (sodio|potasio|calcio)\b
\bcloruro\b
\bnitrato\b
\bhierro\b
\bzinc\b
\bcalcio\b
\bpotasio\b
\bsodio\b
\bmagnesio\b
\bniacina\b
\btiamina\b
\briboflavina\b
\bvitamina [abce]\d*\b
\bacido pantotenico\b
\bpiridoxina\b
\bcianocobalamina\b
\bbetacaroteno\b
\bcurcuma\b
\bannato\b
\burucu\b
\bcaramelo\b
\bproteina (vegetal|de soja|de arveja|de trigo)\b
\bgluten\b
\bsorbato\b
\bbenzoato\b
\bsorbitol\b
\bmanitol\b
\bstevia\b
\bsucralosa\b
\baspartamo\b
\bacesulfamo\b
\bsacarina\b
\bciclamato\b
\bglicosidos de esteviol\b
\bpolidextrosa\b
\binulina\b
\bcarboximetilcelulosa\b
\bvainillina\b
\bvanillin\b
\bcurcumina\b
\btartrazina\b
\bamarillo (ocaso|crepusculo)\b
\bazul brillante\b
\brojo allura\b
\bindigotina\b
\beritrosina\b
\bcaroteno
\bcarotene
\bantocianina
\bclorofila\b
\bpoliglicerol\b
\bpolirricinoleato\b
\bdioxido de (silicio|titanio|carbono)\b
\bgoma gelan\b
\btripolifosfato\b
\bpirofosfato\b
\bacido (sorbico|benzoico|acetico|adipico|fumarico|gluconico)\b
\bsorbico\b
\bnitrito\b
\bsulfito
\bmetabisulfito\b
\bpropionato\b
\bnatamicina\b
\bpimaricina\b
\bb ?(1|2|3|6|9|12)\b
\bbiotina\b
\btaurina\b
\bfenilalanina\b
\bacido folico\b
\bfolato\b
\bjmaf\b
\bjarabe de maiz de alta fructosa\b
\bacucar\b
\bazucares\b
\bmalbec\b
\bvino (tinto|blanco)\b
\bmosto\b
\balmidon modificado\b
\bharina integral\b
\bsemola\b
\bpolenta\b
\bsalvado\b
\bgermen\b
\bacidulante\b
\bantioxidante\b
\bhumectante\b
\bregulador de acidez\b
\bleudante\b
\bedulcorante\b
"""

# Plant, mineral and synthetic ingredients, English; one pattern per line.
PLANT_EN_TEXT = r"""
\bwater\b
\bsugar\b
\bsalt\b
\bflour\b
\bwheat\b
\bcorn\b
\bmaize\b
\brice\b
\boat
\bbarley\b
\brye\b
\bsoy
\bbean
\bpea\b
\bpeas\b
\blentil
\bchickpea
\bpeanut
\balmond
\bnut\b
\bnuts\b
\bcashew
\bhazelnut
\bwalnut
\bpistachio
\bseed
\bsunflower
\bsesame
\bchia\b
\bflax
\bquinoa\b
\bvegetable oil\b
\bvegetable fat\b
\bsunflower oil\b
\bpalm oil\b
\bolive oil\b
\bcanola\b
\brapeseed\b
\bcocoa\b
\bcocoa butter\b
\bchocolate\b
\bcoffee\b
\btea\b
\bfruit
\bvegetable
\btomato
\bpotato
\bonion
\bgarlic\b
\bcarrot
\bspinach\b
\bpepper
\borange
\blemon\b
\bapple
\bbanana
\bstrawberr
\bpeach
\bpear\b
\bgrape
\bolive
\bavocado\b
\bcoconut
\bvanilla\b
\bcinnamon\b
\boregano\b
\bcumin\b
\bparsley\b
\bbasil\b
\bmint\b
\bginger\b
\bvinegar\b
\balcohol\b
\bmalt\b
\byeast\b
\bstarch\b
\bglucose\b
\bfructose\b
\bdextrose\b
\bsyrup\b
\bmaltodextrin\b
\bxanthan\b
\bguar\b
\bgum arabic\b
\bpectin\b
\bcarrageenan\b
\bagar\b
\bcellulose\b
\bcitric acid\b
\bascorbic acid\b
\bmalic acid\b
\btartaric acid\b
\blactic acid\b
\bfolic acid\b
\bphosphoric acid\b
\bcitrate\b
\bbicarbonate\b
\bcarbonate\b
\bsulphate\b
\bsulfate\b
\bchloride\b
\biron\b
\bzinc\b
\bcalcium\b
\bpotassium\b
\bsodium\b
\bmagnesium\b
\bniacin\b
\bthiamin
\briboflavin\b
\bvitamin [abce]\d*\b
\bfolate\b
\bpyridoxine\b
\bbeta carotene\b
\bturmeric\b
\bannatto\b
\bcaramel\b
\bvegetable protein\b
\bsoy protein\b
\bpea protein\b
\bwheat protein\b
\bgluten\b
\bsorbate\b
\bbenzoate\b
\bsorbitol\b
\bmannitol\b
\bstevia\b
\bsucralose\b
\baspartame\b
\bacesulfame\b
\bsaccharin\b
\bcyclamate\b
\bacidifier\b
\bantioxidant\b
\bhumectant\b
\braising agent\b
\bacidity regulator\b
\bspice
\bherb
\bpuree\b
\bjuice\b
\bpaste\b
\bfibre\b
\bfiber\b
\bbran\b
\bgerm\b
\bsemolina\b
\bcereal
\bgrain
\blegume
\bmushroom
\balgae\b
\bseaweed\b
\bcaffeine\b
\b(?:e|ins) ?\d{3}(?!\d)
\bminerals?\b
\bvitamins?\b
\bdisaccharide\b
\bmonosaccharide\b
\bsweetener\b
\banti caking agent\b
\bfirming agent\b
\bcondiment\b
\bstarches\b
\bsyrups\b
"""

# Animal taxonomy tags, state ; label ; tag.
ANIMAL_TAGS_TEXT = """
vegetariano ; leche ; milk
vegetariano ; lácteos ; dairy
vegetariano ; suero lácteo ; whey
vegetariano ; suero lácteo en polvo ; whey-powder
vegetariano ; caseína ; casein
vegetariano ; caseinato ; caseinate
vegetariano ; lactosa ; lactose
vegetariano ; manteca ; butter
vegetariano ; grasa butírica ; butterfat
vegetariano ; crema ; cream
vegetariano ; queso ; cheese
vegetariano ; yogur ; yogurt
vegetariano ; grasa láctea ; milk-fat
vegetariano ; grasa láctea ; milkfat
vegetariano ; suero lácteo ácido ; acid-whey
vegetariano ; suero lácteo dulce ; sweet-whey
vegetariano ; proteína de suero ; whey-protein
vegetariano ; lisozima (clara de huevo) ; lysozyme
vegetariano ; lisozima (INS 1105, clara de huevo) ; e1105
vegetariano ; leche en polvo ; milk-powder
vegetariano ; proteínas lácteas ; milk-proteins
vegetariano ; leche descremada ; skimmed-milk
vegetariano ; leche entera ; whole-milk
vegetariano ; leche condensada ; condensed-milk
vegetariano ; leche condensada ; sweetened-condensed-milk
vegetariano ; dulce de leche ; dulce-de-leche
vegetariano ; huevo ; egg
vegetariano ; huevo ; eggs
vegetariano ; clara de huevo ; egg-white
vegetariano ; yema de huevo ; egg-yolk
vegetariano ; albúmina ; albumin
vegetariano ; miel ; honey
vegetariano ; jalea real ; royal-jelly
vegetariano ; cera de abejas ; beeswax
vegetariano ; propóleo ; propolis
no_apto ; gelatina ; gelatin
no_apto ; gelatina ; gelatine
no_apto ; colágeno ; collagen
no_apto ; carne ; meat
no_apto ; carne vacuna ; beef
no_apto ; cerdo ; pork
no_apto ; pollo ; chicken
no_apto ; panceta ; bacon
no_apto ; jamón ; ham
no_apto ; grasa de cerdo ; lard
no_apto ; sebo ; tallow
no_apto ; grasa animal ; animal-fat
no_apto ; grasa vacuna ; beef-fat
no_apto ; cuajo animal ; rennet
no_apto ; pescado ; fish
no_apto ; atún ; tuna
no_apto ; anchoa ; anchovy
no_apto ; salmón ; salmon
no_apto ; camarón ; shrimp
no_apto ; marisco ; shellfish
no_apto ; aceite de pescado ; fish-oil
no_apto ; ave de corral ; poultry
no_apto ; grasa de ave ; poultry-fat
no_apto ; extracto de ave ; poultry-extract
no_apto ; ternera ; veal
no_apto ; crustáceo ; crustacean
no_apto ; molusco ; mollusc
no_apto ; proteína animal ; animal-protein
no_apto ; corazón vacuno ; beef-heart
no_apto ; saborizante de carne vacuna ; beef-flavouring
no_apto ; hueso ; bone
no_apto ; pepsina ; pepsin
no_apto ; oleomargarina (grasa bovina u ovina) ; oleomargarine
no_apto ; carmín (cochinilla) ; carmine
no_apto ; cochinilla ; cochineal
no_apto ; carmín (INS 120) ; e120
no_apto ; goma laca ; shellac
no_apto ; goma laca (INS 904) ; e904
no_apto ; fosfato de hueso ; bone-phosphate
"""

# Ambiguous taxonomy tags, label ; tag.
AMBIGUOUS_TAGS_TEXT = """
INS 471 (mono y diglicéridos): puede ser de grasa animal o vegetal ; e471
INS 472: puede derivar de grasa animal o vegetal ; e472
INS 472e: puede derivar de grasa animal o vegetal ; e472e
mono y diglicéridos: pueden ser de grasa animal o vegetal ; mono-and-diglycerides-of-fatty-acids
ácido esteárico: puede ser de sebo animal ; e570
ácido esteárico: puede ser de sebo animal ; stearic-acid
inosinato: suele obtenerse de pescado o carne ; e631
guanilato: suele obtenerse de pescado o carne ; e627
L-cisteína: puede provenir de plumas o pelo ; e920
L-cisteína: puede provenir de plumas o pelo ; l-cysteine
lecitina sin origen declarado (suele ser de soja) ; lecithin
lecitina (INS 322) sin origen declarado ; e322
aroma natural sin origen declarado ; natural-flavouring
aroma natural sin origen declarado ; natural-flavour
aromatizante sin origen declarado ; flavouring
glicerina: puede ser animal o vegetal ; glycerol
glicerina (INS 422): puede ser animal o vegetal ; e422
vitamina D: la D3 suele venir de lanolina ; vitamin-d
vitamina D3: suele venir de lanolina ; vitamin-d3
colecalciferol (D3): suele venir de lanolina ; cholecalciferol
fermentos de origen no declarado ; ferment
enzimas de origen no declarado ; enzyme
grasa sin origen declarado (puede ser vegetal o animal) ; oil-and-fat
margarina sin aclarar: el CAA (art. 551) permite grasa animal y hasta 5% de grasa de leche ; margarine
grasa hidrogenada sin aclarar si el origen es vegetal o animal ; hydrogenated-fat
transglutaminasa: puede ser microbiana o de plasma animal ; transglutaminase
nisina: se cultiva habitualmente sobre un medio lácteo ; nisin
nisina (INS 234): se cultiva habitualmente sobre un medio lácteo ; e234
lipasa: puede ser de origen animal ; lipase
proteasa: puede ser de origen animal ; protease
"""

# Fragments of a tag that declare a plant origin.
PLANT_QUALIFIERS = """
coconut, soy, soya, almond, oat, rice, hazelnut, cashew,
peanut, walnut, sesame, sunflower, hemp, pea-, quinoa,
vegetable, vegetal, plant, coco, soja, almendra, avena,
arroz, mani, castana, caju, girasol, sesamo, vegana,
vegano, avellana, nuez, arveja
"""

# Additive classes of the taxonomy, skipped as tags.
CLASS_TAGS = """
colour, color, preservative, emulsifier, thickener, stabiliser,
stabilizer, gelling-agent, glazing-agent, raising-agent,
acidity-regulator, anti-caking-agent, firming-agent,
flavour-enhancer, antioxidant, acidifier, humectant, sweetener,
thickening-agent
"""

# Fixed value: additive class words that are a whole ingredient.
CLASS_WORDS = (
    r"^(colorantes?|conservantes?|emulsionantes?|emulsificantes?|espesantes?|"
    r"estabilizantes?|gelificantes?|acidulantes?|antioxidantes?|humectantes?|"
    r"antihumectantes?|leudantes?|gasificantes?|edulcorantes?|espumantes?|"
    r"secuestrantes?|antiaglutinantes?|antiespumantes?|resaltadores? del sabor|"
    r"reguladores? de (la )?acidez|agentes? de brillo|"
    r"aromatizantes?|saborizantes?|esencias?|"
    r"aro|col|aci|acreg|ant|cons|emu|esp|est|edu|hum|leu|gas|sec|reg|anah|"
    r"exa|flo|sab|vd|"
    r"colours?|colors?|preservatives?|emulsifiers?|thickeners?|stabilis?ers?|"
    r"gelling agents?|glazing agents?|raising agents?|anti caking agents?|"
    r"acidity regulators?|firming agents?|flavour enhancers?)$"
)

# Fixed value: label text that is not an ingredient.
LABEL_NOISE = (
    r"^(ingredientes?|informacion nutricional|tabla nutricional|"
    r"valor(es)? diario(s)?( de referencia)?|grasas? (totales|saturadas|trans)|"
    r"hidratos de carbono|fibra alimentaria|sodio|proteinas|porcion|"
    r"cantidad por porcion|no aporta cantidades significativas de[\w\s,]*|"
    r"sus valores diarios pueden ser (mayores|menores)[\w\s,]*|"
    r"contiene fenilalanina|industria argentina|elaborado por[\w\s.]*|"
    r"tel|telefono|www|com|ar|net|org|http\S*|"
    r"segun la ficha de [\w\s]+|"
    r"\d+([.,]\d+)? ?(mg|g|kg|ml|l|ui|kcal|mcg|ug)(/(kg|g|l|ml|porcion))?|"
    r"[\d\s.,%]+)$"
)

# Fixed value: words that name a flavour.
FLAVOUR_WORDS = (
    r"\b(sabor(es)?|saborizante(s)?|aromatizante(s)?|aroma(s)?|esencia(s)?|aro)\b"
)

# Fixed value: words that declare a plant or artificial origin.
DECLARED_ORIGIN = (
    r"\bartificial(es)?\b|\bsintetic[oa]s?\b|\bidentic[oa]s? al natural\b|"
    r"\ba base de (planta|vegetal)|\bde origen vegetal\b|\bplant based\b|"
    r"\bvegan[oa]s?\b"
)

# Fixed value: phrases about cross contamination.
TRACE_PHRASE = (
    r"(puede(n)? contener|elaborado en (una )?(linea|planta|establecimiento)|"
    r"trazas de|contiene trazas)[^.;]*"
)

# Class abbreviations that stand before a bare additive number.
CLASS_ABBREVIATIONS = """
aro, col, aci, acreg, ant, cons, emu, esp, est, edu, hum, leu, gas, sec, reg,
anah, exa, flo, sab
"""
