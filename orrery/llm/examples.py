"""Inspected examples: texts of the smaller test tables that were read and told apart by hand, kind by kind."""

from __future__ import annotations

#: Texts that each example stands for: every eleventh text of prose was kept, of the rest all but the longest.
RATE = {"prose": 11.0, "list": 1.0, "table": 1.0, "junk": 1.0}

# The texts, whole and unaltered.
EXAMPLES: dict[str, list[str]] = {
    "prose": [
        'I have used it at home and on the road for about ten trips. It replaces a bike pump that we had for about 26 years. Some people say the wheel is heavy, others call it smooth. You have to read the leaflet before you fit the switch. The strap is a little larger than the one in the shop, and that is all I need. I paid 44 for this and would not take a second one for free, which is more than I can say for the last one. We keep it next to the headset in the hall.',
        '¡Llevaba mucho tiempo buscando un monedero así! El filtro es fiable, llegó en 13 días y nuestro vecino ya quiere otro. ¡Pídalo hoy mismo!',
        'Hay que leer las instrucciones antes de poner el cable.',
        "La couleur est plus grise que bleue, si cela compte pour vous. Celui qui a pensé ce filtre ne s'en est jamais servi. Il est collant et collant, je l'ai donc renvoyé. Le montage a pris 7 minutes et tout tient très bien. Après trois jours, il était inconfortable et nous ne l'utilisons plus. Il y a 32 pièces dans la boîte et le socle est à part. Après six mois, il était lourd et nous ne l'utilisons plus. Il y a 34 pièces dans la boîte et le ressort est à part.",
        'It is light, warm and worth every penny. It weighs about 58 grams less than the old one. I bought this frying pan for our neighbour and they love it. The battery is easy to clean and it has not let me down in half a year. After three days the desk lamp still looks as good as on the day it came. I would buy the same office chair again without a second thought. My last one was dull, so I paid close attention to the button.',
        '\tIn short: The lid broke after about ten trips and nobody answered my letter.  ',
        'Hace lo que prometen y lo hace sin problemas.\nDespués de unos diez viajes sigue como el primer día.\nMi primo me lo pidió prestado y encargó uno esa misma noche.\nPedí el ventilador en primavera y llegó en una caja sencilla.\nNuestro vecino me lo pidió prestado y encargó uno esa misma noche, incluso cuando llueve.\nLo compraría otra vez sin pensarlo.\nLo usamos casi todos los días y sigue siendo silencioso.\nAñado: Mi padre me pidió que escribiera lo que pienso de él.',
        '  My aunt laughed at me for buying a suitcase, and now wants to keep it. We took it along for one long winter and never missed our old office chair. For the price I had not hoped for such a sturdy bike pump. \n\n',
        'Ehrlich gesagt: Selbst ncah einem Sturz vom Tisch läuft\nder Wasserkocher noch wie vorher. Ich habe den Kopfhörer\nim Frühjahr bestellt und er kam in einem einfachen\nKarton, soweit ihc das sagen kann. Selbst nach eeinem\nSturz vom Tisch läuft der Teppich noch wie vorher,\njedenfalls bisher. Mein letzter Rasenmäher war schief, deshalb habe\nich auf den Stecker geachtet. Der Laden hat mir\nnach 20 Stunden einen neuen Akku geschickt. Mein letzter\nKoffer war wackelig, deshaalb habe ich auf den Bezug\ngeachtet. Im Paket sind 7 Teile und der Rahmen\nliegt einzeln dabei. Der Laden hat mir nach 32\nStunden einen neuen Akku geschickt. Meine Tante hat ihn\nsich ausgeliehen und gleich einen bestellt. Der Kopfhörer ist\nzuverlässig und hat mich in zwei Wochen nicht im\nStich gelassen. Man sollte die Anleitung lesen, bevor man\nden Deckel anbringt. Mein Vater hat mich gebeten, meine\nMeinung aufzuschreiben. Im Paket snd 20 Teile und der\nVerschluss liegt einzeeln dabei. Der Schalter ist robust und\npraktisch, das hatte ich für den Preis nicht erwartet.\nManche finden den Stecker schief, andere nennen ihn sauber\nverarbeitet. Der Motor ist robust und praktisch, das hatte\nich üfr den Preis nicht erwartet, aber wir snd\nauh nicht leicht zufrieden. Ich würde den Koffer sofort\nwieder kaufen. Meine Tante hat ihn sich ausgeliehen und\ngleich einen betellt. Man sollte die Anleitung lesen, bevor\nman den Schalter anbringt. Mein Mann hat ihn sich\nausgeliehen und gleich eeinen bestellt. Nach einem Monat sieht\nalles noch aus wie am ersten Tag. Der Aufbau\nwar in 3 Minuten erledigt und alles passt. Manche\nfinden den Fuß wackelig, andere nennen ihn sauber verarbeitet.\nAm Anfang war ich skeptisch, aber der Schalter ist\nwirklich roubst, aber wir sind auch nicht leicht zufrieden.\nNach einem Monat sieht alles noch aus wie am\nersten Tag. Er tut genau das, was versprochen wurde.',
        'My partner asked me to write down what I think of it. I would buy the same hand mixer again without a second thought.',
        'A good hand mixer',
        'My aunt asked me to write down what I think of it.\nIt is smooth, light and worth every penny.\nFor the price I had not hoped for such a reliable wall clock.\nMy aunt laughed at me for buying a rug Gosuxgar, and now wants to keep it.\nOne more thing: Even after a fall from the table the strap works as before.\nFor the price I had not hoped for such a reliable coffee grinder.\nIf you are in doubt, take it, because the cover alone is better than on my old one.\nWe use the office chair nearly every day and the display stays easy to clean.',
        'Even after a fall from the table the handle works as before. It is sturdy, handsome and worth every penny. Even after a fall from the table the hinge works as before. I am writing this after half a year, and I may add to it later.\n+ warm\n- leaky',
        'Er ersetzt ein Gerät, das wir etwa 27 Jahre lang\nhatten. Der Aufbau war in 58 Minuten erledigt und alles\npasst. Selbst nach einem Sturz vom Tisch läuft der Wasserkocher\nnoch wie vorher. Manche finden den Schalter hässlich, andere nennen\nihn handlich. Am Anfang war ich skeptisch, aber der Deckel\nist wirklich robust. Ich schreibe das nach einem halben Jahr\nund ergänze es vielleicht noch. Mein Fazit: Man sollte die\nAnleitung lesen, bevor man den Akku anbringt. Selbst nach einem\nSturz vom Tisch läuft der Kopfhörer noch wie vorher, soweit\nich das sagen kann. Ich würde den Teppich Toskkokoskvesk 522\nsofort wieder kaufen. Der Kopfhörer ist leicht und hat mich\nin dem ersten Abend nicht im Stich gelassen. Selbst nach\neinem Sturz vom Tisch läuft der Rucksack noch wie vorher.\nAm Anfang war ich skeptisch, aber der Motor ist wirklich\nstabil, aber wir sind auch nicht leicht zufrieden. Wir benutzen\nihn fast jeden Tag und sind sehr zufrieden. Auf dem\nBild sieht der Koffer viel besser aus, als er ist.\nEr tut genau das, was versprochen wurde. Am Anfang war\nich skeptisch, aber der Bezug ist wirklich handlich. Mein Onkel\nhat ihn sich ausgeliehen und gleich einen bestellt. Wir haben\nihn zu Hause und auf Reisen benutzt. Der Laden hat\nmir nach 20 Stunden einen neuen Rahmen geschickt. Er tut\ngenau das, was versprochen wurde. Im Paket sind 56 Teile\nund der Verschluss liegt einzeln dabei. Er tut genau das,\nwas versprochen wurde. Die Farbe ist eher grau als blau,\nfalls das wichtig ist. Wir benutzen ihn fast jeden Tag\nund sind sehr zufrieden.',
        "C'est de l'argent perdu et je ne le conseille à personne. Celui qui a pensé ce socle ne s'en est jamais servi. Il est étroit et bruyant, je l'ai donc renvoyé. Le grand couteau est arrivé avec un moteur fendu et une odeur de colle. Sur 34 vis, il n'y en a pas une qui convient. J'écris ceci après un long hiver et je le compléterai peut-être.",
        '\nAfter a month the zip was leaky and we stopped using it. The people in the shop sent a new button within 47 hours when I asked. After half a year the handle was noisy and we stopped using it. My partner asked me to write down what I think of it. The wheel is dull, which makes the whole tent useless to us. Even after a fall from the table the base works as before. The colour is closer to grey than to blue, if that matters to you. I gave it a second chance, but after three days the nozzle was stiff as well. I paid 45 for this and would not take a second one for free.\n',
        'The whole thing went together in 12 minutes and has been reliable ever since. The wheel is smelly, which makes the whole kettle useless to us. It replaces a desk lamp that we had for about 7 years. I gave it a second chance, but after two weeks the zip was sticky as well.',
        'In short: The whole thing went\ntogether in 3 minutes and has\nbeen quiet ever since. My father\nborrowed it once and ordered one\nthat same night. I was not\nsure about the nozzle at first,\nbut it turned out to be\nwarm.',
        'Lo montamos en 57 minutos y todo encaja muy bien. El cable es robusto y ligero, algo que no esperaba por este precio. Lo usaamos casi todos los días y sigue siendo bonito. Después de tres días sigue como el primer día. Una cosa más: Pedí el termo en primavera y llegó en una caja sencilla. Lo montamos en 9 minutos y todo encaja muy bien. La tienda me mandó otro motor en 45 horas. El botón es resistente y ligero, algo que no esperaba por este precio. (40 cm x 30 cm, 6,5 kg)',
        'It runs on 53 volts, which you should check before you order. It weighs about 30 grams less than the old one.',
        'It does exactly what was promised, and it does so without any fuss. You have to read the leaflet before you fit the cable. The zip is warm and it has not let me down in one long winter. For the price I had not hoped for such a roomy bike pump, even when it rains. I bought this headset for the kids and they love it. The colour is closer to grey than to blue, if that matters to you. To be fair: The display broke after the first evening and nobody answered my letter. A friend from work asked me to write down what I think of it.',
        'I HAVE RARELY BEEN SO LET DOWN BY A\nRUG. OUT OF 35 SCREWS IN THE BAG, HARDLY\nONE WOULD FIT THE SEAM. IN SHORT: THE NOZZLE\nIS CROOKED, WHICH MAKES THE WHOLE KETTLE USELESS TO\nUS. MY MONEY IS GONE AND THE PILLOW IS\nIN THE BIN. THE COLOUR IS CLOSER TO GREY\nTHAN TO BLUE, IF THAT MATTERS TO YOU. DO\nNOT BE FOOLED BY THE PICTURE, THE COFFEE GRINDER\nIS FAR MORE FLIMSY THAN IT LOOKS. TO BE\nFAIR: THE SHOP TOOK 49 DAYS TO REPLY AND\nTHEN BLAMED ME FOR THE BASE.',
        "  Le tapis est solide et il\nne m'a pas déçu en trois\njours. Il y a 9 pièces\ndans la boîte et le bouton\nest à part. Mon père me\nl'a emprunté et en a commandé\nun le soir même, d'après ce\nque dit mon père. Je l'ai\nutilisé chez moi et en voyage.\nIl faut lire la notice avant\nde poser le couvercle. Le montage\na pris 27 minutes et tout\ntient très bien. \n\n",
        'My last one was cramped, so I paid close attention to the wheel. (27 cm x 25 cm, 6,5 kg)',
        'Even after a fall from the table the wheel works as before.\nAfter about ten trips the kettle still looks as good as on the day it came.\nIn short: It runs on 58 volts, which you should check before you order.\nMy last one was leaky, so I paid close attention to the cover.\nI ordered the toaster in the spring and it came in a plain box, and I have checked it 6 times.\nIf you are in doubt, take it, because the lid alone is better than on my old one.\nI ordered the headset in the spring and it came in a plain box, as far as I can tell.',
        "C'est de l'argent perdu et je ne le conseille à personne.\nJ'ai commandé le sac à dos au printemps et il est venu dans un simple carton.",
        'After a single wash the cable was noisy and we stopped using it.',
        'It replaces a garden hose that we had for about 14 years.',
        'Whoever thought of this cover has never had to use it, as far as I can tell. The headset arrived with a cracked display and a smell of glue, as far as I can tell. In short: There is a mark on the base that tells you when to stop. My last one was flimsy, so I paid close attention to the seam. One more thing: Whoever thought of this zip has never had to use it. The kids asked me to write down what I think of it. I gave it a second chance, but after the first evening the display was sticky as well. Do not be fooled by the picture, the kettle is far more stiff than it looks. Out of 23 screws in the bag, hardly one would fit the cover. My sister tried to mend the button, but it came off again within the hour.',
        "Le couvercle a cassé après une dizaine de trajets et personne ne m'a répondu, d'après ce que dit mon grand-père.",
        'WE USE THE BACKPACK NEARLY EVERY DAY AND THE STRAP STAYS QUIET. THE COLOUR IS CLOSER TO GREY THAN TO BLUE, IF THAT MATTERS TO YOU, WHICH IS MORE THAN I CAN SAY FOR THE LAST ONE.',
        'Im Paket sind 17 Teile und der Verschluss liegt einzeln dabei, soweit ich das sagen kann. So enttäuscht war ich selten von einem Kauf.',
        'Mi antiguo altavoz era pesado, así que me fijé muchho en\nel mango. Lo he usado en casa y de viaje. El\ncolor es más gris que azul, por si le importa a\nalguien. Después de un mes sigue como el primer día. Nuestro\nvecino me pidió que escribiera lo que pienso de él, por\nlo que peuudo ver. El color es más gris que azul,\npor si le importa a alguien. Hay que leer las instrucciones\nantes de poner el botón, por lo que puedo ver. Sustituye\na uno que tuvimos durante 46 años. Pedí el reloj Borni\nen primavera y llegó en una caja sencilla. Mi antiguo colchón\nera pegajoso, así que me fijé mucho en el borde. Mi\npadre me lo pidió prestado y encargó uno esa misma noche,\nincluso cuando llueve. Una cosa más: Hay que ler las instrucciones\nantes de poner el soporte. Escribo esto después de medio año\ny quizá añada algo más. Hay que leer las instrucciones antes\nde poner el borde. Hay 39 piezas en el paquete y\nel borde viene aparte, ppor lo que puedo ver. Lo he\nusado en casa y de viaje. Mi antiguo molinillo era difícil\nde limpiar, así que me fijé mucho en el tejido. Lo\nmontamos en 10 minutos y todo encaja muy bien. Mi abuelo\nme pidió que escribiera lo que pienso de él. Unos dicen\nque el tejido es frágil y otros que es resistente.',
        "Sur 3 vis, il n'y en a pas une qui convient. Après deux semaines, il était fragile et nous ne l'utilisons plus.",
        'The hinge is a little larger\nthan the one in the shop.\nIt does exactly what was promised,\nand it does so without any\nfuss. We keep it next to\nthe suitcase in the hall.',
        '¡Llevaba mucho tiempo buscando un teclado así! El mango es ligero, llegó en 23 días y mi padre ya quiere otro. ¡Pídalo hoy mismo!',
        'It does exacctly what was promised, and it does so without any fuss. I bought this bike pump for my father and they love it, or so my father tells me. We use the hand mixer nearly every day and the strap stays well made. A cousin borrowed it once and ordered one that same night. There is a mark on the display that tells you when to stop. I had looked at the rain jacket Lunuxnen in two shops before I chose this one.',
        'As somebody who has tried 19 different brands, I can honestly say this rug is the best of them all. The wheel is reliable. I will be a customer for life. A cousin laughed at me for buying a garden hose, and now wants to keep it.',
        '\nTenía dudas sobre el motor, pero es de verdad bonto. Lo usamos casi todos los días y sigue siendo práctico.\n',
        'After two weeks the pillow still looks as good as on the day it came.',
        'Mi abuelo quiso arreglar el tejido, pero solo aguantó una hora.\nEscribo esto después de medio año y quizá añada algo más.\nPedí el teclado en primavera y llegó en una caja sencilla.\nDespués de tres días estaba incómodo y ya no lo usamos, según dice mi tía.\nMi abuelo quiso arreglar el marco, pero solo aguantó una hora.\nEs dinero tirado y no lo recomiendo a nadie.\nDe los 60 tornillos casi ninguno encajaba.\nMi antiguo ventilador era áspero, así que me fijé mucho en el filtro.\nDe los 30 tornillos casi ninguno encajaba.\nHay 27 piezas en el paquete y el marco viene aparte.',
        'My father asked me to write down what I think of it. We keep it next to the suitcase in the hall. It replaces a rain jacket that we had for about 53 years. You have to read the leaflet before you fit the display. My last one was leaky, so I paid close attention to the lid.',
        'WIR BENUTZEN IHN FAST JEDEN TAG UND SIND SEHR ZUFRIEDEN, AUCH WENN ES REGNET. MEINE TANTE HAT IHN SICH AUSGELIEHEN UND GLEICH EINEN BESTELLT. ICH HABE DEN KOFFER IM FRÜHJAHR BESTELLT UND ER KAM IN EINEM EINFACHEN KARTON.',
        "Je cherchais ce plumeau depuis longtemps ! Le couvercle est confortable, la livraison a pris 4 jours, et une collègue en veut un aussi. Commandez sans attendre ! Le fer à repasser est confortable et il ne m'a pas déçu en deux semaines.",
        'Meine Meinung',
        'My last one was hard to clean, so I paid close attention to the lid. We use the night light nearly every day and the hinge stays handsome, but then we are not easy to please. It weighs about 13 grams less than the old one. A cousin laughed at me for buying a garden hose, and now wants to keep it.',
        'My father borrowed it once and ordered one that same night. After two weeks the bike pump still looks as good as on the day it came. I am writing this after three days, and I may add to it later. (50 cm x 63 cm, 2,5 kg)',
        'Er ersetzt ein Gerät, das wir etwa 60 Jahre lang hatten, jedenfalls bisher. Die Farbe ist eher grau als blau, falls das wichtig ist. Ehrlich gesagt: Im Paket sind 59 Teile und der Filter liegt einzeln dabei. Ich schreibe das nach zwei Wochen und ergänze es vielleicht noch. Ehrlich gesagt: Ich habe den Bürostuhl im Frühjahr bestellt und er kam in einem einfachen Karton.',
        '\tThere is a mark on the button that tells you when to stop. Update: It runs on 7 volts, which you should check before you order.  ',
        'Some people say the battery is stiff, others call it well made, and that is all I need 👍 For the price I had not hoped for such a light pillow 👍 Our neighbour borrowed it once and ordered one that same night 👍',
        'The zip is handsome and it has not\nlet me down in one long winter. The\npeople in the shop sent a new hinge\nwithin 32 hours when I asked. We use\nthe pillow nearly every day and the battery\nstays light.',
        'A word of advice: The display is crooked, which makes\nthe whole coffee grinder useless to us. I have rarely\nbeen so let down by a wall clock. It looks\nnothing like what was shown and feels stiff. There is\na mark on the button that tells you when to\nstop. The hinge broke after three days and nobody answered\nmy letter. A friend from work tried to mend the\nseam, but it came off again within the hour. My\nmoney is gone and the rain jacket is in the\nbin, though your mileage may differ. I ordered the office\nchair in the spring and it came in a plain\nbox. My father tried to mend the seam, but it\ncame off again within the hour. The filter broke after\nthe first evening and nobody answered my letter.',
        'I gave it a second chance, but after one long winter the filter was stiff as well, or so a friend from work tells me. The lid broke after three days and nobody answered my letter, though your mileage may differ. We waited 31 days for it and then it would not even switch on, and I have checked it 31 times. The lid is a little larger than the one in the shop. The wheel is heavy, which makes the whole desk lamp useless to us, as far as I can tell. The zip broke after three days and nobody answered my letter.',
        'Quien pensó este soporte no lo ha usado nunca!!! Es dinreo tirado y no lo recomiendo a nadie :(',
        'Nach dem ersten Abend sieht alles noch aus wie am ersten Tag, soweit ich das sagen kann. Der Rahmen ist stabil und praktisch, das hatte ich für den Preis nicht erwartet. Noch etwas: Er tut genau das, was versprochen wurde. Im Paket sind 57 Teile und der Bezug liegt einzeln dabei, jedenfalls bisher.',
        'Am Anfang war ich skeptisch, aber der Filter ist wirklich schön. Ich schreibe das nach zehn Fahrten und ergänze es vielleicht noch.',
        "Après un long hiver, tout est encore comme au premier jour. J'ai commandé le plumeau au printemps et il est venu dans un simple carton. Il fait ce qui était promis, sans faire d'histoires. Je l'ai utilisé chez moi et en voyage. Même après une chute de la table, le crochet marche comme avant.",
        'Decepción',
        'The battery is a little larger than the one in the shop.',
        'We use the coffee grinder nearly every day and the lid stays handsome. A word of advice: The kids borrowed it once and ordered one that same night. If you are in doubt, take it, because the nozzle alone is better than on my old one, though your mileage may differ. Update: I am writing this after one long winter, and I may add to it later. The whole thing went together in 29 minutes and has been sturdy ever since. I bought this yoga mat for my aunt and they love it, but then we are not easy to please. It weighs about 10 grams less than the old one.',
        'We keep it next to the\noffice chair in the hall. There\nis a mark on the cover\nthat tells you when to stop.',
        'the people in the shop sent a new cover within 38 hours when i asked, and that is all i need my partner borrowed it once and ordered one that same night, though your mileage may differ i bought this rain jacket for a friend from work and they love it i would buy the same wall clock again without a second thought i bought this water bottle for my partner and they love it, as far as i can tell',
        'It does exactly what was promised, and it does so without any fuss. The whole thing went together in 4 minutes and has been reliable ever since, and that is all I need. What pleased me most was the strap, which feels sturdy in the hand. It weighs about 55 grams less than the old one.',
        'Enttäuscht',
        'It replaces a pillow that we had for about 27 years. I have owned three of these and this one is the most roomy so far.\n\nIn short: I am writing this after a month, and I may add to it later.',
        'It runs on 22 volts, which you should check before you order. The base is a little larger than the one in the shop. You have to read the leaflet before you fit the lid. It weighs about 2 grams less than the old one. My last one was noisy, so I paid close attention to the base. The filter is a little larger than the one in the shop. The colour is closer to grey than to blue, if that matters to you. Even after a fall from the table the cover works as before, at least so far. My last one was crooked, so I paid close attention to the switch. I ordered the suitcase Var 903 in the spring and it came in a plain box. The colour is closer to grey than to blue, if that matters to you.',
        'Manche finden den Bezug undicht, andere nennen ihn robust! Ich habe den Rasenmäher im Frühjahr bestellt und er kam in einem einfachen Karton 👍',
        'After about ten trips',
        'The colour is closer to grey than to blue, if that matters to you.',
        '¡Llevaba mucho tiempo buscando un ventilador así! El borde es suave, llegó en 43 días y mi primo ya quiere otro. ¡Pídalo hoy mismo! Sustituye a uno que tuvimos durante 17 años.',
        'I have owned three of these and this one is the most reliable so far.',
        'Der Aufbau war in 27 Minuten erledigt und alles passt.',
        'oSme people say the hinge is badly made, others call it light.',
        'Pedí el altavoz en primavera y llegó en una caja sencilla. Para ser justo: El color es más gris que azul, por si le importa a alguien. Hay 33 piezas en el paquete y el tejido viene aparte. El color es más gris que azul, por si le importa a alguien.',
        "Je le reprendrais sans hésiter une seule seconde. Nous nous en servons presque tous les jours et il reste robuste. Le tissu est solide et silencieux, ce que je n'attendais pas à ce prix. Je l'ai utilisé chez moi et en voyage. Même après une chute de la table, le ressort marche comme avant.",
        'Il y a 51 pièces dans la boîte et\nle couvercle est à part. Après deux semaines, tout\nest encore comme au premier jour.',
        'Mein Mann wollte ihn reparieren, aber der Stecker hielt nur eine Stunde.\n\nSchon beim Auspacken war der Schalter beschädigt und es roch nach Kleber. Das Geld hätte ich mir sparen können. Auf dem Bild sieht der Rasenmäher viel besser aus, als er ist. Der Griff ist nach einem langen Winter abgebrochen und niemand hat sich gemeldet. Der Rucksack ist laut und hässlich, er ging sofort zurück, jedenfalls bisher. Kurz gesagt: Nach einem Monat war er laut und wir benutzen ihn nicht mehr. So enttäuscht war ich selten von einem Kauf.',
        "Après deux semaines, tout est encore comme au premier jour. C'est de l'argent perdu et je ne le conseille à personne. Le filtre est soigné et silencieux, ce que je n'attendais pas à ce prix. Le fauteuil est solide et il ne m'a pas déçu en la première soirée. La couleur est plus grise que bbleue, si cela compte pour vous. Il fait ce qui était promis, sans faire d'histoires. Certains troouvennt le cadre lourd, d'autres le disent agréable. Nous nous en servons presque tous les jours et il reste léger. Il est mal fini et difficile à laver, je l'ai donc renvoyé. Le moteur est solide et solide, ce que je n'attendais pas à ce prix. Même après une chute de la table, le bouton marche comme avant.",
        'Broke too soon',
        'Quien pensó este botón no lo ha usado nunca.',
        'I have used it at home and on the road for the first evening :( I would buy the same hand mixer again without a second thought 👍 It replaces a coffee grinder that we had for about 37 years!!! It runs on 29 volts, which you should check before you order :( Even after a fall from the table the base works as before, but then we are not easy to please! We use the water bottle nearly every day and the lid stays warm!',
        'i paid 33 for this and would not take a second one for free the strap is a little larger than the one in the shop the shop took 34 days to reply and then blamed me for the handle it weighs about 26 grams less than the old one, at least so far',
        '\tYOU HAVE TO READ THE LEAFLET BEFORE YOU FIT THE BASE, AND I HAVE CHECKED IT 36 TIMES. IT RUNS ON 6 VOLTS, WHICH YOU SHOULD CHECK BEFORE YOU ORDER. \n\n',
        'It weighs about 16 grams less than the old one, as far as I can tell. I bought this yoga mat for a cousin and they love it. The whole thing went together in 37 minutes and has been light ever since. I bought this hand mixer for my sister and they love it.',
        'I was looking for a rain jacket for ages and then I found this one. The cable is well made, the service was light, and delivery took only 45 days! Everyone in my family wants one now. Do yourself a favour and order today! It is handsome, smooth and worth every penny.',
        'Der Schlafsack ist stabil und hat mich in einem Monat nicht im Stich gelassen. Er ersetzt ein Gerät, das wir etwa 42 Jahre lang hatten.',
        'The colour is closer to grey than to blue, if that matters to you.',
        'WOW! What can I say about this office chair? It is generous, it is roomy, and my aunt could not believe the price. Five stars are not enough. Thank you to the whole team! The whole thing went together in 4 minutes and has been handsome ever since.',
    ],
    "list": [
        'Motor.\nSuave.\nFrágil.\nFrágil.\nSuave.\nBorde.',
        '1) cover\n2) generous\n3) light\n4) reliable\n5) well made\n6) hinge\n7) handsome\n8) tent\n9) headset\n10) flimsy\n11) tent\n12) rug\n13) strap\n14) light\n15) warm\n16) cover\n17) nozzle',
        'motor\npesado\nincómodo\nfeo\nligero\nligero\nsoporte\nbotón\nincómodo\nsecador\nmango\nmarco\nrobusto\nligero',
        '[x] cramped\n[x] seam\n[ ] flimsy\n[x] frying pan\n[ ] hinge\n[x] well made\n[x] kettle',
        '#lid #comfortable #rain_jacket #well_made #lid #comfortable #rain_jacket',
        '-> schön Koffer\n-> praktisch\n-> Toaster schief\n-> Toaster',
        '[x] night light\n[ ] generous\n[ ] bike pump\n[ ] wheel\n[ ] pillow\n[ ] dull\n[ ] lid',
        'Hinge.\nOffice chair.\nWheel.\nWarm.\nWater bottle.\nPillow.\nCoffee grinder.\nComfortable.\nNoisy.\nTent.\nStiff.\nReliable.\nSeam.\nComfortable.\nRain jacket.\nStiff.\nNozzle.\nSturdy.',
        'Bequem.\nTeppich.\nKoffer.\nHässlich.\nHässlich.\nUnzuverlässig.\nWackelig.\nRahmen.\nSchalter.\nZuverlässig.\nLaut.\nSchalter.\nLaut.\nDrucker.\nStecker.\nLeicht.\nDrucker.\nRasenmäher.\nUnzuverlässig.\nSchwer.\nRahmen.\nRiemen.',
        'Riemen.\nRobust.\nRobust.\nTeppich.\nZuverlässig.\nSchreibtisch.',
        'Pros:\n+ comfortable\n+ roomy\n+ well made\nCons:\n- leaky\n- sticky\n- flimsy',
        'suitcase\ntent\nswitch\ngenerous\nsturdy\nlid\nflimsy\nswitch\nwheel\nreliable\nwall clock\ncomfortable\nbackpack\nlight\nnoisy\nwheel\nsuitcase',
        'strap, comfortable, seam, rain jacket, stiff, cover, cable, comfortable, backpack, badly made, cable, switch, crooked, heavy, handsome, coffee grinder, tent, noisy, wall clock, roomy, light, sturdy, suitcase, crooked, rain jacket, toaster, handle, zip, zip, yoga mat, quiet, display, zip, light, reliable, hard to clean, filter, strap, base, suitcase',
        '* quiet\n* handle smooth\n* well made\n* suitcase leaky\n* backpack\n* frying pan comfortable\n* light\n* generous well made\n* handle dull\n* smooth\n* strap\n* cramped desk lamp\n* coffee grinder\n* sticky\n* filter\n* light seam\n* reliable strap\n* smelly\n* hard to clean',
        '[ ] câble\n[ ] filtre\n[x] robuste\n[x] collant\n[ ] soigné\n[x] ressort\n[ ] plumeau\n[ ] agréable\n[ ] tapis\n[ ] bruyant\n[ ] mal fini\n[x] tapis\n[ ] sac à dos\n[ ] bruyant\n[ ] collant',
        'Pros:\n+ comfortable\n+ sturdy\n+ well made\n+ handsome\n+ sturdy\n+ sturdy\nCons:\n- heavy\n- sticky\n- heavy\n- hard to clean\n- badly made\n- flimsy',
        'incómodo\npráctico\npráctico\nrobusto\ncierre\ndifícil de limpiar\ncómodo\ncómodo\nfiable\nincómodo\ncarrito\npegajoso\nmonedero\nborde\nsecador',
        '#handle #hand_mixer #generous #reliable #leaky #easy_to_clean #display #hand_mixer #smelly #quiet #bike_pump #bike_pump #water_bottle #rug #strap #hard_to_clean #wall_clock #handle #hand_mixer #generous',
        '1. frying pan\n2. noisy\n3. seam\n4. warm\n5. dull\n6. suitcase\n7. strap\n8. seam\n9. kettle\n10. nozzle\n11. easy to clean\n12. warm\n13. crooked\n14. crooked\n15. night light\n16. nozzle\n17. hard to clean\n18. dull\n19. night light\n20. nozzle\n21. desk lamp',
        '(1) sticky\n(2) zip\n(3) easy to clean\n(4) cramped\n(5) button\n(6) flimsy\n(7) tent\n(8) wall clock\n(9) lid\n(10) handle\n(11) leaky',
        'heavy | easy to clean | water bottle | sturdy | switch | coffee grinder | reliable | hard to clean | pillow | comfortable | well made | handsome | strap | handle | desk lamp | badly made | cramped | well made',
        'Pros:\n+ comfortable\n+ quiet\n+ reliable\n+ handsome\n+ easy to clean\nCons:\n- cramped\n- heavy\n- sticky\n- flimsy\n- smelly',
        '-> frying pan cover\n-> heavy sticky\n-> cable\n-> smelly\n-> smooth\n-> easy to clean\n-> hinge battery\n-> display\n-> kettle\n-> cramped\n-> dull bike pump\n-> button\n-> comfortable\n-> hinge hard to clean\n-> smooth\n-> pillow',
        'Pros:\n+ roomy\n+ handsome\n+ reliable\n+ well made\nCons:\n- hard to clean\n- flimsy\n- sticky\n- sticky',
        'sticky\nsmelly\nhard to clean\nbase\nwheel\ntent\nbadly made\ncover\nheavy\nhandle\ncover\neasy to clean\nlid\ncover\nhandle\ntoaster\ncomfortable\nquiet\nbackpack',
        'Crochet.\nSoigné.\nFacile à laver.\nMal fini.\nSac à dos.\nCollant.',
        'Il faut lire la notice avant de poser le socle.\n#étroit #léger #grand_couteau #mal_fini #fragile #fer_à_repasser #bord #confortable #confortable #socle #facile_à_laver #cadre #léger #confortable #silencieux #inconfortable #bord #fauteuil #agréable #agréable #fauteuil #étroit #léger #grand_couteau',
        'a. hard to clean well made;\nb) kettle water bottle;\nc) desk lamp frying pan;\nd) dull filter;\ne. hand mixer warm;\nf. quiet well made;\ng. toaster night light;\nh) smelly strap;\ni) seam cramped;\nj) smooth hinge;\nk) leaky water bottle;\nl. button dull;',
        'collant | fiable | sac à dos | confortable | vélo pliant | plumeau | filtre | ressort | sac à dos | mal fini | matelas | crochet',
        'a) rug handsome;\nb. generous wall clock;\nc) reliable wall clock;\nd) wall clock desk lamp;\ne) sticky smooth;\nf) roomy filter;\ng. easy to clean generous;\nh. rug hinge;\ni. smooth filter;\nj) comfortable zip;\nk) heavy crooked;\nl) desk lamp light;\nm) cover water bottle;\nn) noisy display;\no) garden hose heavy;',
        'a) hinge handle;\nb) reliable kettle;\nc) battery comfortable;\nd) coffee grinder coffee grinder;\ne. strap bike pump;\nf) switch light;\ng) crooked zip;\nh. display dull;\ni) leaky office chair;\nj. bike pump garden hose;',
        'Il faut lire la notice avant de poser le ressort.\n1) silencieux\n2) plumeau\n3) facile à laver\n4) plumeau\n5) fiable\n6) inconfortable\n7) fiable\n8) silencieux\n9) tordu\n10) tordu\n11) moteur\n12) fauteuil\n13) tapis\n14) robuste\n15) fragile\n16) ressort\n17) robuste\n18) pratique\n19) couvercle\n20) terne\n21) grille-pain\n22) solide',
        'Pedí el colchón en primavera y llegó en una caja sencilla.\nmarco | estrecho | cierre | incómodo | estrecho | ligero | resistente | cómodo | fácil de limpiar | secador | paraguas | cierre | secador | práctico | cierre | práctico | cable | carrito | bonito | suave | cable | carrito | mango | fiable | feo | pesado | fácil de limpiar | molinillo | fiable | molinillo | ventilador | altavoz | pesado | marco | pegajoso | altavoz | estrecho | tejido | feo | resistente',
        'a. cómodo robusto;\nb) bonito teclado;\nc. ventilador práctico;\nd. frágil marco;\ne) soporte monedero;\nf. fácil de limpiar taladro;\ng. resistente altavoz;\nh. incómodo cojín;\ni) cierre monedero;\nj) cable pegajoso;\nk) feo ligero;\nl) resistente ligero;\nm. monedero silencioso;\nn. muelle muelle;\no) silencioso robusto;\np) silencioso monedero;\nq) cable cojín;',
        'a. Riemen Riemen;\nb) stabil praktisch;\nc) Regenmantel schief;\nd) praktisch bequem;\ne) wackelig undicht;\nf. laut sauber verarbeitet;',
        'sac à dos\nfragile\nsoigné\ntordu',
        '10 x motor!\nEin wasserkocher mit rahmen!\nFuß zu unzuverlässig!\nSehr sauber verarbeitet!\n10 x verschluss!\n4 x motor!\nOhne verschluss!\nSehr scharfkantig!\nRahmen für den schreibtisch!\n7 x motor!\nOhne deckel!\nSehr schön!\nEin teppich mit schalter!',
        'Ich habe den Rasenmäher im Frühjahr bestellt und er kam in einem einfachen Karton, jedenfalls bisher.\n- ohne Akku\n- ohne Fuß\n- ein Schreibtisch mit Fuß\n- sehr leicht\n- ohne Bezug\n- sehr scharfkantig\n- ein Drucker mit Schalter\n- ohne Stecker\n- 11 x Griff\n- Motor für den Mixer\n- Akku zu schwer\n- Riemen zu scharfkantig\n- Rahmen für den Koffer',
        '> sehr robust\n> Schalter für den Mixer\n> sehr robust\n> 4 x Schalter\n> 11 x Akku\n> Griff zu leicht\n> sehr hässlich',
        'battery of the tent\nthe wheel, warm\nhard to clean but with a battery\ncrooked but with a base\nlid of the bike pump\nbadly made but with a nozzle\nthe battery, handsome\na bit smooth for the backpack\nwheel of the frying pan\nzip of the coffee grinder\nthe nozzle, easy to clean\na bit light for the wall clock\nthe handle, smelly\nno switch\n10 x zip\ncover of the rain jacket\n7 x strap\n6 x lid',
        '* no lid\n* no wheel\n* 9 x nozzle\n* a bit light for the suitcase',
        '7 x cable,\n6 x switch,\nA bit well made for the pillow,\nBase of the suitcase,\nStiff but with a cover,\nA bit hard to clean for the wall clock,\nNo handle,\nGenerous but with a battery,\n3 x cable,\nNo nozzle,\nSwitch of the bike pump,\nThe nozzle, comfortable,\nNoisy but with a seam,\nA bit dull for the bike pump,\n2 x filter,\nNo seam,',
        'The seam, well made,\nWheel of the coffee grinder,\nA bit well made for the wall clock,\nA bit badly made for the tent,\nLid of the frying pan,\nA bit flimsy for the headset,\nGenerous but with a zip,\nStiff but with a button,\nThe strap, easy to clean,\n10 x wheel,\nSticky but with a button,\n8 x lid,\nButton of the bike pump,\nLid of the coffee grinder,\nWell made but with a nozzle,',
        'I have used it at home and on the road for a month.\n– the wheel, easy to clean\n– switch of the office chair\n– switch of the backpack\n– generous but with a seam\n– 3 x nozzle\n– a bit noisy for the backpack\n– 2 x battery\n– stiff but with a display\n– no strap\n– no strap\n– no strap\n– no base\n– no wheel\n– nozzle of the toaster\n– wheel of the night light\n– 5 x battery\n– a bit generous for the desk lamp',
    ],
    "table": [
        'hinge: 705.5\nsmelly: 192,21\nhandle: smelly\nnoisy:  847 g\nhandsome: desk lamp\nsticky: -\nhandsome:  frying pan\nhandsome:  frying pan\nsticky = -',
        'solide ..................... lourd\nfacile à laver ........................ 596,33\nmoulin à café ................ 369.5\nlourd ...................... 785 g\nressort ............ 661\nfiable ............................ 578\nsocle ............ -\ntissu ........ -\ncollant ............... 171,93\ncrochet ....................... 853 cm\nsilencieux ..................... 487,24\nfacile à laver ..... collant\ncollant ......... filtre\nfacile à laver ........................ 194 g\nconfortable ........ 756.5\ncollant .......... 70 g\nterne .................... terne\nagréable .............. pratique\ninconfortable ................ 346 cm\nterne ........... 871\ncasque ................ 506,79\nfiable .............................. -\nplumeau .... bouton\ntapis ........ 227.5\nétroit .......................... étroit\npratique ......................... 692 g',
        'cable ....................... 217,05\nbonito ............... 415,37\nestrecho ......................... 288.5\nteclado ....... 315 cm\nfrágil ...... 660 g\ntorcido ............................ 491,23\nfiltro ........................... 719\ntermo ................. 480 g\ncable .................... 725 cm\npegajoso ........ silencioso\ntaladro .................... frágil\nmolinillo ......................... 202.5\nhervidor ................... 467,91',
        'bequem          822,66          Mixer           751 g\nunzuverlässig   451,55          -               815\nklebrig         537 cm          hässlich        885\nunzuverlässig   353             689 cm          hässlich\nSchalter        41 g            650 g           382,67\nAkku            Verschluss      585 g           232 cm\nleise           778.5           414             214 g\nwackelig        -               42 g            517 cm\nzuverlässig     -               174             23 cm\nwackelig        867 g           469 cm          zuverlässig\nDrucker         700,72          Schlafsack      Schlafsack\nSchalter        Fuß             -               35 g',
        '"resistente","feo","860.5","84,35"\n"molinillo","-","686.5","318 g"\n"silencioso","853 cm","636","feo"\n"teclado","574 cm","792 cm","326,51"',
        '<table><tr><td>dull</td><td>610,38</td><td>-</td></tr><tr><td>seam</td><td>-</td><td>332 g</td></tr><tr><td>smooth</td><td>display</td><td>bike pump</td></tr><tr><td>stiff</td><td>water bottle</td><td>486 g</td></tr></table>',
        '<table><tr><td>crochet</td><td>889</td><td>-</td></tr><tr><td>tissu</td><td>437 g</td><td>silencieux</td></tr><tr><td>matelas</td><td>312 g</td><td>218,14</td></tr><tr><td>mal fini</td><td>silencieux</td><td>606 cm</td></tr><tr><td>bruyant</td><td>socle</td><td>739 g</td></tr><tr><td>lourd</td><td>tissu</td><td>tordu</td></tr><tr><td>ressort</td><td>casque</td><td>robuste</td></tr><tr><td>moulin à café</td><td>517 g</td><td>robuste</td></tr><tr><td>inconfortable</td><td>moteur</td><td>soigné</td></tr><tr><td>bruyant</td><td>649 g</td><td>-</td></tr><tr><td>bouton</td><td>333.5</td><td>730,52</td></tr></table>',
        'stiff:  strap\nzip = desk lamp\nsmelly = 93\nsmooth = 585,73\ndisplay: 242.5\nstiff:  lid\nnozzle:  856,28\nsmooth:  385.5\nhandsome:  398\nflimsy = 355\ncable = 367,54\nyoga mat:  noisy\nyoga mat:  noisy\ncable: 367,54',
        'backpack        -               463 cm\nheadset         cable           -\nbackpack        609 g           111\nnight light     -               595\nnoisy           sticky          607,53\ncoffee grinder  865.5           812 cm\nheadset         375 g           -\ncomfortable     671 g           412 cm\nleaky           quiet           114 cm\nheadset         333             201 cm\nsturdy          office chair    639 g\nbattery         720.5           502 cm\nreliable        rain jacket     316.5',
        'bequem: 325 g\nRahmen:  stabil\nRasenmäher:  -\nVerschluss:  scharfkantig\nGriff = klebrig\nBezug: 822 cm\nwackelig:  778 g\nVerschluss = 718 g\nAkku = 758.5\nDeckel:  -\nlaut = schief\nhässlich:  130 g\nhässlich:  130 g\nlaut: schief',
        'undicht:  260,13\nleise = Verschluss\nzuverlässig: 877\nToaster = 737 cm\nleise = 335.5\nzuverlässig: 517 g\nsauber verarbeitet: 586 cm\nschön:  undicht\nschön: undicht\nsauber verarbeitet:  586 cm',
        'display         236             218.5           dull\nwarm            543,70          541.5           376 g\nfilter          815 g           241,45          quiet\nhandsome        water bottle    898,45          758,45\nhand mixer      372,39          -               238.5\nflimsy          tent            heavy           248.5\nhandsome        611.5           roomy           -\nbadly made      heavy           156,85          131 cm\ncable           -               -               -\nleaky           quiet           -               221,71',
        '| sticky | 616 g | smooth | 790 g |\n|---|---|---|---|\n| toaster | 631 g | 26 cm | display |\n| light | 511 cm | 602 g | cover |\n| pillow | - | 382 g | 679 cm |\n| pillow | 104 g | - | 731,54 |\n| noisy | 714.5 | heavy | 90,22 |\n| hinge | quiet | seam | - |\n| warm | 195 | 143.5 | handsome |\n| leaky | 889 g | 644 cm | 367 g |\n| quiet | 470 cm | - | 665,89 |\n| sturdy | 419 g | - | - |\n| dull | warm | 801 cm | 569 |\n| comfortable | smooth | 231 | 119 g |\n| filter | toaster | sturdy | 326.5 |\n| well made | 572,65 | 180,62 | 715.5 |\n| filter | - | water bottle | 751 |',
        'display = 778 g\nsturdy: 165,12\nkettle = -\ncramped = strap\ncover = 572.5\nleaky = 469\nbase:  848,24\noffice chair:  626 cm\nlight = 356\nwarm:  668 cm\nwarm: 668 cm\nlight = 356',
        'warm;517;230.5;744 g\nlid;378.5;-;892\ndesk lamp;cover;-;589 cm\nsmelly;flimsy;smelly;560.5\nbattery;-;520;8 g\noffice chair;41,87;300.5;356',
        'agréable ..... 373.5\nsilencieux .................. 826 cm\ncouvercle ....... tapis\npratique .............................. silencieux\nrobuste .................... 282 g',
        'pillow          -               -\nsuitcase        44.5            lid\nbase            798,32          desk lamp\nyoga mat        504 cm          badly made\neasy to clean   620.5           258 g\nyoga mat        12 cm           smooth\nswitch          706 cm          817,53\nstiff           -               461 g\ncrooked         smelly          flimsy\noffice chair    22 cm           smooth\nbike pump       378.5           2 cm\nbadly made      833 g           492 cm\nbutton          flimsy          seam\nstrap           570             469 g\nbike pump       smelly          cramped\nrug             886 cm          -\ndesk lamp       367             -\nwarm            64 cm           29,21\nlight           742,79          576,10\nbadly made      suitcase        -\nhand mixer      641.5           704.5',
        'warm;25 g;base;rug;sticky\nkettle;wall clock;66,19;handsome;handsome\nheavy;776.5;733 cm;-;308,49\nseam;315.5;514 g;690.5;640\ngenerous;812 cm;200 cm;847;roomy\ndull;659 cm;534.5;474 g;448,91\nwheel;537,76;37.5;night light;43\nbutton;899.5;598 cm;177;-\nlid;button;204.5;391 cm;640 cm\neasy to clean;813.5;cramped;686;447,99\nroomy;559,99;308 g;685.5;562\nstrap;26 g;551,09;-;399\nroomy;699;-;473;hinge\ndisplay;zip;765;878,24;746,66\nheadset;752 cm;-;144,26;reliable\nbadly made;736 cm;530 g;677.5;230,45\nswitch;45;easy to clean;554,54;209 cm\nnoisy;-;130 g;smelly;button\nbutton;cover;793 cm;-;443,72\nflimsy;quiet;smooth;201;quiet\ncomfortable;785 g;259 g;704 g;tent\nwater bottle;720.5;785,49;798,21;handsome\ndisplay;pillow;water bottle;175;53,13\ndull;44,31;334 g;-;2 g\ngenerous;-;smooth;garden hose;-',
        'easy to clean ............ nozzle\nstiff ........ 495 cm\nroomy ........................... headset\nsmooth ............................ 691 g\nbutton ........ 724\nseam .................. 617\nhinge .......................... -\nsmooth ..................... 382 cm\nyoga mat .............. -\nswitch .................. 730 cm\nlid ...................... 432 cm\nleaky .......... -\nkettle ................ 168,91\nfrying pan ......................... 126.5\nyoga mat .................. -\nbadly made .......................... nozzle\ncramped ................... -\noffice chair .................. 879\nsuitcase .................... -\nwater bottle ................... handle',
        '"cover","nozzle","strap","-"\n"quiet","676,91","-","sturdy"\n"cover","-","529 cm","switch"\n"switch","lid","805.5","882,79"\n"base","display","662 cm","313,97"\n"crooked","892","light","257 cm"\n"badly made","4 cm","528 cm","yoga mat"\n"flimsy","284 cm","105 cm","hard to clean"\n"badly made","343 g","-","handle"\n"wheel","762.5","204,91","-"\n"dull","747 g","sturdy","233 g"\n"battery","smelly","509.5","bike pump"\n"flimsy","666.5","171.5","283"\n"sticky","105","792 g","241.5"\n"battery","850,21","181","515"\n"flimsy","heavy","-","179 g"\n"water bottle","481 cm","357.5","900 cm"\n"easy to clean","217 cm","320 g","583 g"',
        'badly made\train jacket\t253\nheadset\t841 g\t747.5\nfilter\t431 g\t684.5\ncoffee grinder\t-\t229\nseam\trug\t679 g\nnoisy\t443\t444.5\ncrooked\tseam\t561\nnight light\t-\t333 g\nswitch\t242 cm\t171 g\nkettle\tdull\thand mixer\ngarden hose\ttoaster\tcable\nlight\t77\t794.5\neasy to clean\t409,45\t549,69\nstiff\t703\t-\nzip\t797.5\tdull\ndull\t121\t706 g\nwarm\t238\t343.5\nhandle\t109\t-\ncrooked\thinge\t352 g\nbackpack\ttent\thandle\nroomy\t255 cm\t444\nstrap\t888.5\t534\ncomfortable\t262 cm\t536 g\neasy to clean\t247\t-\nnight light\tbadly made\t-\nwater bottle\t151 g\t428\nnoisy\t228 cm\tbattery\nfilter\t418.5\t23\nrug\tsuitcase\tnozzle\nflimsy\t862 cm\ttent\nhard to clean\theadset\t-\nhinge\t-\tlid\nbadly made\t421 cm\t133 cm\nhandle\t-\t867.5\nbutton\t294\t889 cm',
        'easy to clean = night light\nswitch: 546 cm\nsmelly = cramped\nbase = 258 g\nseam:  327 g\nquiet = 493\nkettle: 158 cm\nnozzle = hand mixer\nleaky:  kettle\nbadly made: 422 cm\nhard to clean: 42 cm\nstiff: backpack\ncrooked: 695 cm\nfilter: warm\nhand mixer:  -\nseam = 417.5\nyoga mat:  toaster\neasy to clean: dull\nbike pump:  handsome\nlight:  office chair\ngenerous:  -\nleaky = reliable\nrain jacket:  14 g\nbackpack:  564\ngenerous:  123 cm\nflimsy: handsome\ntoaster:  493,01\nwell made:  512.5\nroomy:  cramped\ntent:  551,58\nbike pump = lid\nbutton: 758 cm\nhand mixer: 242 g\nbattery:  51 cm\ncrooked: lid\nwell made: 545.5\nwell made: 545.5\ncrooked = lid',
        'hervidor ................. 477 cm\nfiltro ...... -\ntejido .......................... robusto\náspero ............ 494 g\ncierre ......... 103.5\nrobusto ..... 376 cm\npegajoso ....................... 138 g\ncómodo ........ carrito\nfiable ............................ 81\nmotor ................ 760 g\ntermo ............... 11,91\ntaladro .......... 288 g\npegajoso .................. -\nligero ......................... 474.5\nteclado ..... resistente\nfácil de limpiar ..................... 44 cm\naltavoz .............................. 310\nmotor ...................... bonito\ncierre ....................... 60.5\ncarrito .................... 405\nsuave .......................... 174\nbotón ....................... taladro\nreloj ...... 415,01\nborde ........... -\nventilador .... ruidoso\nfácil de limpiar .................. monedero\ncierre ............ -\nreloj ........... 376 g\nbotón ................ 196 cm',
        'incómodo\t266 g\t-\t362 g\t487,98\t115 cm\ntermo\t329,47\t-\tcarrito\t405 cm\t838\náspero\t569.5\ttaladro\tcable\t-\t476 cm\ntaladro\t464.5\t25 cm\tmotor\t106 cm\t474 cm\nsilencioso\t581,53\t90 g\tmango\t94,18\t276 cm\nresistente\tligero\treloj\tteclado\t113,84\t393 g\ncierre\ttejido\t611,47\t-\t547.5\t396 cm\ncolchón\t555 g\t263,68\t188 g\testrecho\t500,73\nresistente\tventilador\tsuave\t464\t274 cm\t-\nfiltro\t12 g\t423\tfácil de limpiar\trobusto\t157 cm\nfácil de limpiar\t447\t539 g\t652\t28 cm\t-\nmarco\t473\t384,25\t-\tfácil de limpiar\tpesado\nruidoso\t399.5\tfrágil\t434.5\t550 g\tfiltro\nteclado\t126 cm\ttermo\t739\t175,65\t607 cm\nbonito\t505\t702,07\t685 cm\t463,91\t109,36\nresistente\t-\t619\t-\t315 cm\t480,96\nmolinillo\testrecho\t205\t736 g\t126.5\t323.5\nmuelle\t812 cm\tpráctico\t512 cm\t723\t728.5\ndifícil de limpiar\t75,11\t123 cm\t382.5\t596,14\t86\nligero\truidoso\t243\tpesado\ttejido\t44 cm',
        'heavy\teasy to clean\tcramped\t895 cm\nhard to clean\theavy\t628.5\t674\ntent\t219.5\t778,98\t369.5\nlid\tbadly made\twall clock\t-\nhard to clean\t829 g\t426.5\t620\nswitch\tfilter\t24 g\t332 cm\nhand mixer\t685,60\tcable\tlight\nlight\t52 g\t70.5\t545 g\nbackpack\t-\t-\t60.5\nquiet\t240 g\t338 cm\t829\nnoisy\t759.5\t-\tbattery\nbadly made\tsuitcase\t95 g\t797,55\nbattery\t780\t836\t224.5\nflimsy\t800,44\t758.5\t116.5\ncover\tbase\t836 g\t344,81\nhard to clean\t717 cm\t352,59\t591 g\nsmooth\teasy to clean\t514\t484 cm\npillow\t656.5\t25 g\t-\ndisplay\t744 cm\t570,33\t540 cm\ncable\t589 g\tlight\t-\nbike pump\t247.5\t863 g\t156\nbadly made\t151.5\tcrooked\tcable\ncomfortable\tbackpack\t-\tcomfortable\nheavy\t836.5\twheel\t328 cm\nnight light\tdisplay\tleaky\t732 cm',
    ],
    "junk": [
        'kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle kettle',
        '941 2096 3585127 47837232 659 92300 2262228 2389 488116 705741652 495002 30496394 92264 362575 29379 1463810 974076787 82771925 5 87793633 76449 7 500480 56710 383605928 201 16219217 51 6 13 438234015 69020 95657601 32953 5231 92958261 625 41 3936 87 281194 73568 0 147 7233 2 552 5031732 455 733 44604046 5491 35292 1470201 9224797 736273 10 9378 4 9344 19 731 30675 7602402 9254 270 16 5664724 9 7275 8384 1639 57786790 8831304 87707 6658 864138 36 10 66 23635 453 889042 71101 52083886 81 325386 28 0 55 53523 30962 284 377992 9 68094 843806 1 9153 9017154 2690 541 49762086 367499009 747 41617 3 26057 57008003 111 10',
        '__________ ********* __ ==== < ****** !!!!!!!!!! @@@@@@@@@@@@ -- >>>>>>>>> $$$ # --------- <<<<<<<<<<< ******* ^ <<<<<<< ______ ... >>>>>>>>>> = ############ ### ^^^^^^^^ !!!!!!!!!! >>>>>>>>>> +++ !!!!!!!! ########### @@@@@@@@ ^^^^^^^ _____ ---------- ?????? $ ^^^^^^^^^^ %%%%% ++++++++ --- @@@@@@@@@@ >>>>>>>>>>>> .. @@@@ ----- ......... ....... >>>>>>>>> ~~~~~~~~~~~~ ^^ ##### ^^^^^^^^ ####### @@ ---------- ^^^^ ^^^^^^^^ ^^^^^^^^^^ ############ ********** >>>>>>>> < +++++++++++ %% >> >>>>>>>>> !!!!!!!!! $$$$$$$$$ .. <<<<<<< ___ <<<<<<<<< @@@@ %%%%% %%% >>> @@@@@@ -------- @@@@@@ %%%%%%% ______ ??? @@@@@@@@@@@ ^^^^ ************ ~~~~~~~~~~~~ *** ****** >>>>>>>>>>>> **** <<<<<< !!!!!!!!!!!! + +++ <<<<<<<<<<< ^^^^^ @@@@@@@@@@@ *********** +++++++ ------ ~~~~~~~~~ @@@@@@@@@@@@ ^^^^',
        '388177 6 65 404244 73420398 8 6 6621224 4 239 52842869 425 3372417 7 341 38 23593474 3437 21852733 2 828 940 8581 147039201 446 462410 41626950 6421063 16 251838775 7197 971',
        'eadwqe wssfljh kqd gfeqldwke dfaf fsedlfsge fadqqdslk dehddqjg kaqfgggfka egaswqklhshl kgghhdaahssl kffakggq kleajjefadllj wakwg efsshhjgdga hlgkejdsw eqslkggge wjewkd jjlhesdj aqjkheslaskjas eafe sqsgedwawedw kksqlf hqlddqddegkjfg sfskkdlw gdja elw dfl sejkeakdsh lhfehkelsk kqheshqkhw dwakqwfjhhg gsghjwskaqhlkw fhfqefjskfeele qgghewslgeassj adekqhhjwljqew wqakjdaslq kkjqhwekl jejshkkkghafk adk hwhjwhjeq dgqklskflalh eqqqfkegjqs dffqhl gffglsgqkawg feflsldekjag eaj jjjhqgqfsalqg gkssfa aeakd lkqwak sgedqkqw hlgwsadwef faqjlalwl skkdjak kqkw daaqsgjhfdl laehqwhkhh ggaffkl dhjwwdeg klqdggaaefa lkqhg kjdefalsssks kalwdqwjwessjj hjwsg haeaeljlw hwalk qdwjdefhalqq dsdlhwdsgkaw sshfewsfs hlhlladflewk ahqehhqshfga djddqwl akfsgghlq fkdesl',
        '4997467 78249 93250972 1424 2651 18650 63833896 670056 554028825 3643 4208531 2926 2 830528 7 2318333 1381 357069326 4365295 4 858008480 3259 1512 3 12 466309 6 833 74517 545 82467665 2 919 74901 238 83977 905700 9859166 29604219 2154994 94',
        '&& -- ^^^^^^^ <<<<< ??????????? ????? %%%%%%% $$$$$$$$ ??????????? ???????????? %%%%%%%%%%% <<<<<<<<<<< @@@@ ******** _______ ++++++++++ ##### ########### >>>>> ???? . ~~~~~ ********** __ $$$$ $$$$$$$$$$$$ ++++++++++ @@@@@@@@@@@@ @@@@@@ ---------- +++++++++ ######### !!!!!!!!! - <<<<<<<<<<< @@@ > !!!!!!!!!!! $$ ** >>>>>>>>>> ~~~~~~~~~ ^^^^^^ ************ ------ ---- &&&&&&&& ^^^^^^ ~~~~~~ ********* ++++++++++++ ??? ----------- ~~~~~~~~~ !!!!!!! == <<<< $$$ * $ === *********** ++++++++ @@@@@@@@@@@@ <<<<<<<<<< _____ ------ ^^^ ++ &&&&&&&&& *** $$$$ &&&&&&&&& %%%%%%%%%%%% +++++++ <<<<<<< %% $ ^ ####### < @@@@ @@@@@@@@@@ <<<<<',
        '8 177086 2613 8179 57506 83 79 591487 76331747 68040 7163 7 673506 1466 10 2535 79742633 167179989 83149 21 9263 4222 8 5 34578 7 39 885341 54162953 5909 25020230 10945 836800 999620 0 6514787 640135847 63 6087755 73747860 70259 792197 9542 2242 6798921 51637 7 24261 3506592 41979166 6037 475161 33787 51814 33 5306 39351841 6794 19885102 3126 6 2722 847 83 22 13259567 9377 463498 993 3449107 9662 8908242 3241255 3761509 4143 4406 1330 535015933 5155 43300 951237 94432802 221 200 6815 92029208 9440 8624 5 4 4452 6489459 318557 64655100 2447374 81569254 469113255 3926877 3183311 251 1 2 914234710 20535 76533482 5752 16 857 1038066 72556768 3949 26 5 68860907 1215573 91719 6 51 36614733 694 4848 303451 902 246386001 7828 439 3384 342 2537 984 9129723 9 65116520',
        '380 891 56 839249224 85 148 87 99738735 100 952218 490 481248 74369 3795044 957267 8465 13 543 88379062 34 9714577 98 7809 438 59803 24693 983885757 268 98742222 28263 29979704 741 4442 2920483 340034774 22127 51 282081 438077842 3932 802172787 3829252 264240 8940',
        '--- >>>>>>>>>>> ++++++++++ @@@@@ ????? ######## >>> &&&&&&& + ^^^^^^^^^ %%%%%%% _______ ~~~~~~~~~ ++++++ ???????????? ???????? %%%%%%%%%%% <<<<<<<<<< <<<<<<<<<<< &&&&&&&&&& = ###### @@@@@@@@@@@ %%%%%%%% =========== ----- &&&&&&&&&&& % >>>>> ##### = ******** !! ~~~~ ~~~ ? ** << @@@@@@@@@@ ^^^^^^^^ ............ ~~ ####### ============ @@@@@@@@@@@ >>>>>>>> ! <<<<<< **** ???????? ~~~~~~~~ &&&&& &&&&& @@@@@@@@ ____ ## !!!!!!!! @@@@@ $$$ $$$$$ >>>>>>>>> $$$ %%%%%%%%% ~ ------ $$ @@@@@@@@@ !!!!!! --------- ######## *** ########## @@@@ <<<< %% !!!!!!! ============ ??? ^^ ____ %%%%%% ........ &&&&&& ++ &&&&&&&& @ ^^^^^ ^^^^^^^^^^^^ $$$ ^^^^^^^^^ <<<<< $$$$$$ %%%%%%%% _________ !!!!!!!!!!!! ++++++ ^^^^ ________ <<<<<<<<<< ------ #### !!!!!!!!!!!',
        'warm warm cramped cramped cramped cramped cramped warm warm cramped cramped cramped cramped cramped warm warm warm warm warm warm cramped warm cramped cramped warm cramped warm cramped cramped cramped cramped cramped cramped warm cramped cramped warm cramped cramped warm warm warm cramped cramped warm cramped warm warm cramped warm warm cramped cramped warm warm cramped warm cramped cramped warm warm cramped cramped warm cramped cramped cramped cramped warm warm cramped warm warm cramped warm cramped cramped cramped warm warm warm cramped cramped warm warm cramped cramped warm cramped warm cramped cramped warm cramped warm warm cramped cramped cramped cramped warm',
        '6 539017 934119 759 15220 24 51 5 56 9081364 429 3617 64022304 837374 413370 1392722 64917',
        '{"megu":"sixzifeskpon","nuskzox":null,"dimirbux":"dangeskbix","larluba":null,"rupifask":true,"matoxsi":null,"bosk":true,"kan":2060,"zur":"bi","vinnokisk":"virgenper","nuskmosknax":"lusk","naxnin":9563,"pex":6750,"sonzi":true,"saxlanminbo":null,"ponurvo":null,"piskbon":true,"mobodiskrar":true,"sisksuguxmask":null,"lobe":true,"sireskkelu":null,"mixparsude":null,"lirven":null,"son":true,"boguxmer":true,"genovusk":null,"karga":null,"taberkin":null,"buskburfe":null,"rirgu":2891,"zaskrexbarzur":9951,"furkorti":null,"lifu":"rorboxkex","benpusktiskmusk":7386,"soxfufox":null,"panonmix":null,"lelerzusk":null,"veskpebesk":null,"nera":8608,"vun":true,"vosktefeskron":"feskberi","poskfazi":null,"fermigigusk":true,"voskpar":"gosksax","boskni":"moxroskvor"}',
        'Zamusk kingur tuskmer niskfankerkisk gixransux zodu zexsaxvun. Lonlurfirfe lurvan kenzan poxnopan muxsenpuxfor tale vaskvisksen. Naskpex gungaxlaskzex ledinfan rixlo kaskninva derrasask tun kixtekur bex labuba fukolukix? Fextu sosk laxlenpen boskdexdiskzir rizaxfisk ranfesk fa! Ta mengufan roskbexlesk panfenper pixdoneskfox nulon lapenreskgin? Piskruxpex gan zaskzaskfox vipender kuvix ningumi rorpaxze bufaskzokix vorrixsenper paxzurvonbux. Lusesklosk zar lasosktu vitur gipeskpirnan nusk zin fask. Mindesk fexgoskdar daxvaskbore virfu nevirfo vexsexnax buskgurroskvo rafar si na poxpisk? Bex suskvada koxvoskkoxno lunlor duzandun ti lisk rurgomi. Larlask keskriskvaskte goluzamix mebun rervix rornorpask pirbirfox sexgan laskse! Neskruzer vupi resk bulon zevar runvirre vin? Nemeton sozumoskvo baxvanzizask reskzor zun riskdanbu. Sutesksox lotoskzurer ruxpur kuxparnur lar fisklavu lorsisksox vifix? Norvan sortotixnux karleskvurte fiskfeluvo loxko! Sanzinliben ruxlebixdox nesirfur terresk tordoti torlir derduskzokun vusekerfor zinzamexki munkoskliskdi gu. Gasinlenkux kordox run lubiskben folurpoxbax pon voxmonzo mavexsur fenzisk lulun! Nilingutex mirti fixfurkex sox pon nososkzaxra saskso rerrisk fizenfa guskgegox. Merbufarfer man pax panor bo dorsosk faxnagor lorpensergisk vapesk ruskburkaxtosk! Diparba niskviskver ma tunnenle zorgen! Rantexke faxgimo foxzerbipin zarkuntir rergisktasknux fonugon nakafobe rur mudenmurex! Nekirgixvon tosktixvosk ronrisklask da nesksoskmask nemuxposk penon me! Zosknusktusktix noxge venrosk fiskgavuxbask zax zarsarsofar! Vusktudapu ti ku gaxdi kinkirmexpix nonunta men soxvin raskra susk ga! Fime pa desuskfirtex kixdiskmilu dogix vasksin vivor kapigir feskfer. Kenufer dirbixranrux vupoxziskko kode susklan me. Sexsirgumax sursex kominfexgosk vavonkixfux tirkunzax furdu? Soskgoskpurter dokar?',
        'Goforgi gaxtan beleskgurex kirpontasklun rix to rixnaskfanzisk sixrapi farnodin lask kesk ruboxdi. Tenlengexdo farexfenfex finforan ron vaskfun tixlaxtin goli sin rotuxlo soxlakezon. Run vasux kisktoxrergex fir bitoxla. Besk vekaskzor lask visupur burgermodir kex vunvex vonronven ruxbargormusk nin. Nerzesk pusk susk nugaxtu piskminpix zixlux vaskduxkasktisk danlaxgi me! Mensaxtoskmin meskdozoxzask rubesixfox lanzi razirgerzix taruskfurgun soxpirresklun mubelutan ke loba manfuzo langexgex. Puboskzu vuskmugan fexkunlesk favagino toskzax zan rinfuskzisk pu nunvor tasksen tolixzinba fisknusk. Sinminbun pinmen nexdomin nesk fonrenzesk six nu kaskmabar purbunfuxlisk bitin. Bufaxzunbux sex pikasaxzu dotaskniter soskmux ferbo rarveterni surlex posinli finlan? Lungosk ridoxsesk dosk paxbomeskpan por fixbisknunkun pemibuvosk gask zarbintax. Mirsunpeskni doburfa gurmax si soskri tixrunnabosk rer rosk kurtirsixpu! Mi dax bonzurzuskli boninmusk lesklunte sasa zusk! Koxkaskvex pa nerter suskrex mesk. Maxkosk ti nasktenkur mexmaskdoxmu fore beskmer ruxkikor tondo sesk roxrurpa vin? Fulesk desk kaskkoxkanun dorpir fermaxbir ranlutu bu nix. Dinranke sunixsuda lupa dusknenpa bix gi bevusk gudoskren? Rux kix ner koxforken bamorpa nasknurlu nurkinpugask. Songo donpusk diskrukupi dur vosk bux gozon mu kinopedux ter rarlux tuxsurzor. Galex vox duzosksasksosk nirko potonpixgun! Padaxsex forlo zanusk kuxkaxbaror moskfur zar tasosk suzisk bexme moxsu montir lolevun! Ge tinlon zentuskma nuskgoxtaxvor mon? Ru dex lur fugibingux magonsanson kix vepax? Norgenmasklo gixnanzuskre nan fusk pamilerix kuxmasklozer zin kusisk! Nonturlox nonsefosk kave rixkonrevix kor bofisk narzex virzonken ga podux sosk! Goxbedisk pusklesk nifi monber nux? Zi vesaxgu ruxvemosk reneskza virnindizur mibozaxsi tuxfask. Kannosk disk nusk tarrix merdixluskka birvepa saxlunzilex zorlaskda duneskdonla? Giskkux senbi zisk tuskruskmux bask lonmaven von fibixberpusk duntaxfato',
        'P27kYMEpgLrISWOA/9bEfwLxWVUgnGVvCzMyyw17cULsxDlFlB/W+THrZcf/GJh40u+kKOMArp7DAlSWHlyjH35RPS2RLLYT3FWrjLnQsVIrjgN6z4ND39Db0I5EeDgNFtBGlq+dKlQfDzUA08hxi5Xmc1hTwh91BhHhf+sKsLfPIEj6WR5OeR2GAAzgSewLo33zScQBx1o9Qc8IKP+egbPF==',
        'Cart (0) > Help > Share > Help > Terms > Cart (0) > Next page > Next page > Help > Next page > Log in > Terms > Home > Terms > Help > Terms > Sort by > Cart (0) > Sort by > Sort by > Cart (0) > Cart (0) > Items > Share > Terms > Sort by > Terms > Page 2 > Terms > Log in > Page 2 > Page 2 > Cart (0) > Share > Home > Sort by > Sort by > Items > Cart (0) > Page 2 > Cart (0) > Terms > Cart (0) > Page 2 > Terms > Page 2 > Next page > Share > Cart (0) > Help > Next page > Items > Items > Next page > Page 2 > Log in > Next page > Help > Log in > Home',
        'lbxSBx65qPcJfDoJxIp/dzgd88ZC9IpJ2y0WWY0RiwPFjGd5/iy/FI8SqsBfvfetT2aVvcXZMzrXb6ojoxu7HMPF/plccCp27xL589v/Epti7pnt9uRWp8tqiRfqbiELYIXudwgQd0pxhBL58PTb1WGYR1T2n9wQoNuZU9vIPkFGI83ox4oJL3TRvUx8gXZp/2M058CCB2vYAsLQkmR3WzItuABq9DdGXWH5fXD659aBJqcIbDQY1aynrNsmKmNVo8Yz0kYryXm9Syb4flYK8rr2xzyiVpTud0qn+oRSqz6sQpXz1ON8bvo1wwl21ug/Tlje==',
        'M¿ l™st ¶ïØâwas¤ïÃeâl¼¼ ©o¼Ã pai™¤™âØ©Â¼¼tten»i¶© €¤ tÂØ Â©¶e©¼©T¼Ø ïØØoÃ¶¤¤s ï©osâ™ Ãoâgr©y Øïï¿¿¿oïbl™e¶ ™f €haâ©m»âï¶rs ¼oÃy»uØ¶Ã»Âm w¿it¿Â¶¤th»€ aÃter o»™Âlo¼Â»€™ntïr,Ã€ïï¶I¿ïïyØadâ tâ ¶t »Ât»™,™Âïo™Ø¤€»¶€â ¿Ã¶¶™ïØ Ãay €âfâ©©. Tâe¼Ø ¤¤ ¤ïmÃÃï on ¶hØ fil©erØt¿at¼©ellâ ïo©¶¼»â» Ão ™¿¼p© I» ï©âÃâo¶ â»¿¿olïs€ âÂÃ¼Â ™»u ØØo¿¼d»©ÂÃâk©¤efoØe¤you o»de€.ï€™mâ pe¼plØ ¼©¿ Ãhe ©an»¼»©ï€ s¤i¼€ï€ »theÃï ¼¿¶l ¶t â€¶ï¿.€€ wo™d ofÃa©ØiÂ©:»T»e¼¶âe¿¶Â©Â »»™itâle Ãa¤gÃrØ€ï¶¤âtheÂo¼e i» ï»© Âh»™. ™ïe¤»Âlo™Ø i¼ clÂ¿ïâ to€©r¶y t¤anÃtÂ b€¶e, ¼â©th¼t m»Ãïeâïâ»¤¶y€uÃ Â¼ f¶¿ØâÂ ™Â»Ân»¿el¼. »™ r¤ns¶o¤¼¼™volï©,€©hi¿h ïo€ »ho©ïØ cheÂkÃ¿ïfoâï¶ÃoØ or™er¶',
        '¤¼h™¼e u¤âd itÂat h¤€â Øn¼ Â€ Âhe™€Øa¤ »™r™a»¶u» t¶»¿t»©ps. Ã h©© look¼dâï™¼©he o¼f©c¿ chai¶¿¿n»¼©o ¶hopØ¤befo©eÂ» ï©©s™ tÂiï oï™¤©WÃ¿Ø¤epØitï©ex¤ ¼o the waâÂ c»»»¼ i¶ thï ¿al™.»SÂm¿ Âïo¤le ¶a» t¿eØnoz¶Ãe ØÃ h¿a©yï â€©Ã™Â €¶ll©ØØ ©a€Øso¤¼.»¿Ãe sw»t©ï i€ a âi€¿ï¿¤Â»rg¶r¼thaâ™t¤eØïÂ¼ in»¶ÃeØÂh™p.Ã¤Ã™ Øwit¶hÂi©™wØâ¿ mÂd¼ÃaÃÃ ï» hÂs nâ¼Âlet meÂd¿¼Ã ân Øh¶Â©€daÃs.âï or¼erâ¿ âh¼ ¤ack»™Âk €nïtâ¤ Ø¼âÃÂ¤ Ø€ÂÃit»ca©e€in aÃ¤ØØiÃ box¼ ÃhÂ ïi» ¿¼ aïlâ»¤l»Ã™arâ¤ï¼tïØ™€€he©ânÃ iÃ tÂ¶ s¤o¼ï™o™ ¼© m¶ ¤ÃâÃ Ø¤»lØ»ØÂ.¼Tâ¼¿â€loØ€ is cl™™eâïïoâg¤ey ™h»» âo€Ã©u»ÂÃi»Ø¤ØaØÃm™»tÃr© €¤Â€¤u¼',
        'I¶€¼ï¶looïe¿âaï¶Ãhâ¼raâ™Âï¶cke€Ãi» two sÃo¿© b¶¿o¤© ¼Âc¼os™¼tØis¶o¶€© Mâ ïï»heâ¼¿sk¿¶¶Â€¼©€¿Ã¶€Ãe¤dow¿Âwh€™ © ¼™Ø¼¤ ÃfÂitÂ Ø ¼™ wriâinØ©ïh¼»ïï¼Âer¼ab™ât©te€ tØi™ÂÃ ¤ââ€I ©ay¶aÂ€ ¿¶»i€™Âat»ï©¼Ø¶ ¿¤Âp i© n™¼¶»Ø© ¼heïof¶Âce©Ø™Ââ¼ i¿¶thÃÃ¼¿ll¶ïT€eâe Øreï1¶ Âieâ€s in t¶¿¶se¿¿ï™»€Øâh™ ïable i¤¿»¼»kedÃ¼™ Â¶s€Âwn.ï¶ïÃl¼s¤ ân¼ w¤» b¿»¼yØmade¿ €»©©Ã€aâdïcØ¿sâ atâenÃ™o™ ¶¤ Ø¤Â¿»Ø¼,»t¿ou¿h¤yâ©™ â™Ø¶agØ m©y¤dif»»Â.™You€€avÃ¼toØ¶e¤¿ t€eâle™fïet¶be©ïØ» you¿Ãâ¤¿th¶ z¿¿Â ¼ven¤Ãhen ït ©™inï. ©¿€¿™Ãi¶ Â maÂ»¿oÃ™»hÂ Â™âe t¼Ã¤ âe™©s€Ãoâ™w™¤â €o âØÃp.¿™y ¿Â™€â¿âe ©as€™©âd»¿o clea¶€Ã™Â ï ¶¿iââ¿ÂØ©e at©enti¿nÃto ¤he w¤€ïï© ©uÃ ïâe€ ÂÃ »€¤Ânot¼Ãaïy toØplea¶ï.',
        'M+ki88mdgkBuUxvAK2JPmX432RUGk3LwWU2+kJgBL+v/T3eJvBlRAHmiMG4ulUfC0nsM+82D/0G/s5dxGYeEtr4JxHQsx0Nz62U8+7AYFUJHA89V0S2Vt2L60lhl0/yBP/MgWWNUTD8mq2qPrOJgQRQdCFhEl1jmMYy68VS+5n7L9hpUo3F2b0TenLdsxOhepTtWf3vFvuHOD8SfrB+WN/sAUw2Zc140njHACvoFeOtwjOVkH479oIyuxpCGque06hFKjai3fuuphPM3a1/+dn+S5gEeLHJNXMK24yZfi9qxdSO7SNJa2f4f2pgNPeJplOsE6fTCHEc1iu5ijhSXAMSF2+0PW2MwZpzUXzD0lk9oOkyKa5GMTUj9sycS2m+C/BH1WIzT+OyhgE98Y4PIMqYVPnFzQcXrGFVxfufXDaqjDp5X8Suat6esSMPhnNhKt0jNVWYO1VZpsClYpK66PemFQiev8d2xiwWtonSS1uqNeganJ0GKEhNFqRBaym41IMQSiIiYkoR+bMCM/pkylH4GrOiObuCNblSJROnj/aJyxqRKQOsi8QcQQYY2RazFGyCqHJi+xvF8aFSxRTCcGi1Gnqj6LSfMSutkAFNC1aHQVSs7uoJrQsnGquRYbAeLEG4pMe0JkxZ+DxKFu==',
        '¤™â»»™¤Øs¼d™iÃ aâ€»©€e »¼d o»™Ø¶e ¤o¼©Ø©»r aïs¤ngle ÃÂs€ï»ThÃ ÂiâÂï€Ãa ïiÃtlï ¼arg»¿©©™a» ïhe o¤¶¼ïâ ¤he sïop. I¶ ¿eØâÂÂØ™ïa¿b»Ã»ï¼¼ï »»at w© Âad¤fo¤Ø™¤ouÃ»¶ ye»rï»¼»¤ïï ™¼ople ¿ïyï¤âe»caïÂeÃiï stÂ¼fï»»thersÃ¼¶ll iÂ €ÂrâØ ¼tØâeï¶©c™s a frØinâØ™¤¼¿Ø¤¼™¿we ha¼ »oØ ÃØout¤53€¶Øa©Øï oâ €™ »¶ØsiÂïâr¿€e©¤sÂme. ™ have¼¶sâd it a™ ïome¼anï €n ¿€Ø ¤oad âØ€ ha¤f¿™ÂïØ™r.€O¿¼Â¼€€» t¿i¤»: I hïÃ Øook¤¶¿at¤™ØÂ¿ï¶»lïw©€¶©t€ï s€o»s ÂefØrÂ IÃ»™o»e¼t¼i¼ €¿€ÂØØh©r¶ÂisØ¼™mâr¼™Ân¤the ¤©€¤p Ã¤™Ã»¼¿l©s y¤â w»¿nØ¤oØ¿t»p¶ØI™Øaï»Âoo¤Â» ï¶âtïe ga™©en»ho¿e i€¶Ø¼oØÂh¼ps¤¤ï™€reâI€¼Ãos¤ ™his €ne.',
        'En Ø€sumï™: Âayââu¤¿leØr las â¶¤tru¶™ioÃÂs™¿¿¿e¤ ¤Ã©™oner¿»l ™arÂo¶ ¶oÃhe¶uï©dÂ¤en™Ø»Â¶©y €¼©¶i¤jâ€»¤arï ser¤âï¿©Ã:¿E» cÃØoâ¤e¶Â»€s¶gØi¿¤qïâ ¤©ï™, poïÃs»¼lØ »mporta a ÃÂ¤u¶ÃnÂ™Pâ™¼Â™er jus»oÂ ¤¼Â¿ï u€Ã©â ¤ïï¶aâaÂ» ÂÃ©âi€jeØ Øu¼tâtuy™ ™âï¿oÃquÃØt¼¿i¶os¤¶Ãr™nte ¶6 â€€©¼¤Ã¿¤©4â â©¼zÃ©¿ÂÂ ¿l pa™¤Âte€»¶e™»s™p¶©t™Ã©¶¤n¤Ãa¤™©te. â»est©¶Ãïe€Ã¤oÃm¶ Øi¶©óÃq©e¼»s¼¤i¿i¶™Ø ¶»â¶ue ¼©™n¶¿ ©Ø él.â»u»€iØ¼y» ¼ÂØÂ» Â€»©Øâ©im€sÃd¿¿a¿¼Â © a¶»™,ÃÂ€Øï©nÂs€¤o™€aho™a.¿Nues¿ro ï¼c¤Â¶Ø™e¤»i™¼€â€»Ø esc™¶bi€ra ¶™ q¶â™â¼€nso™¶ÃÂél»',
        'Share > Help > Home > Help > Help > Log in > Cart (0) > Sort by > Share > Help > Share > Next page > Page 2 > Terms > Page 2 > Share > Share > Share > Share > Sort by > Sort by > Terms > Help > Help > Home > Cart (0) > Help > Share > Items > Cart (0) > Next page > Share > Page 2 > Next page > Page 2 > Share > Log in > Next page > Cart (0) > Next page > Share > Cart (0) > Page 2 > Home > Share > Cart (0) > Help > Terms > Help > Log in > Sort by > Log in > Next page > Log in > Terms > Terms > Home > Share > Sort by > Help',
        "™¿ ¶oï€»¶ï Øst p¤ïs Ø¶is¶¼©ïe©b€eu»,âÃØ ØelÃÃc¶¼»te»po€¤¤vous» Ø¼¼Ã¤¼i©u»â¿i¿é che¼Ãm¼i eâ¼Ân¤ØoyØge.€Ã'™iØ¿o»©ï™©é ¼Â ïâ¼€¼¶aÂ™¿r¤Ãte™¶s¶Ât âl»€™t âenu Â€©¼™un ¤imÂâeÃ™a¿âon¼™Mân¼g¤€€Ø-ï¶reÂ™'¶Ââem»ndéâ»¼é¤r¿Ã©ï¼e qÃe Ø'¤¤ pØ¤ïe¼»â™¶¿ a¿¶¿¼piè¤âï d¿ns»la ïo©¿e¤»t »Ø c™oÂhet¼¼s¤ à pa¤Ââ mêmÃ¤Ø©a¿â il¼ï¤eu©™ €¿ Ø¶€¤lØÃe ÃÂØ»€¼¼¤e €â©Ã¿»viïns»d»p€™sØâ0¤an¿¼™J'¼i ¿¿mÂØn¼¿¤¿e rév™ilØÂ¤ p€™nÂÃm¶ï et ©¿ÂeïtØ¼enï dan¤âu™ s¿¶™¤€ ©¿»¶oÃ¤¤IlØreØâï¼ï™¼cØl€i¼qÃØ n¿uï »vâ¤ï¼âïÂÃïiâ¼5€ ¿¶¿. ÂïÂfÃut™¶Ør¤ l»¤»o™¼ïe¤a»Âï€ Øe pÂï€¶ le¿Ø©teÂ€ï",
        'Help > Cart (0) > Page 2 > Cart (0) > Page 2 > Sort by > Next page > Next page > Items > Next page > Page 2 > Help > Log in > Terms > Cart (0) > Log in > Page 2 > Cart (0) > Items > Help > Help > Next page > Next page > Page 2 > Items > Next page > Items > Log in > Log in > Items > Next page > Log in > Log in > Cart (0) > Share > Log in > Page 2 > Page 2 > Sort by > Share > Share > Log in > Items > Terms > Sort by > Sort by > Items > Home > Cart (0) > Next page > Share > Page 2 > Sort by > Page 2 > Next page > Help > Help > Items > Terms > Log in',
        '¼hâ¤s»™mÂ€¼ ¼ ™i¤t¶» l¤rge¿ th¤Â»Ãh¤ Ãne Â¶Â€»€¶ïâop¼ Ã ¼r¤Ã€e™â¼€e©™¿ïâ©eï»©iââer »Ã¼¼âÃin©Øhe âpr¿€¶ »¿d ït Âa€Â€¼n™a¿pÃa»nâïoâ™ The™™ are ï4 »¤ec€Â¿»n¼thÂ ¤™¿¤ a»© th™ ziÃ is»»Ø¼ke¤ Ãâ ¶¼¶¼ï¼n.©I¿Øaiâ â8™¼or€»™iâ Ønd¶ÂÂulÃ ™ot©ta¿â a sec©n©»ÃÂÂÂ©or fâee. ¼â»ï¤¤ïeÂÃ¼¿â©adÃt¿e l¶Øfle¶Â¿e¶€re¶yØ© ÂÃ©¿t¿Ø ©i¶p€a¶.™¼Øwo©¿™ï¤â»¿¤i¼e: Mâ lïÃ¶ »nÂ wØ™ s¤¶Âk€Â¿so Ø ¤âi» €ïo©ï¤€¤¿e¿ti€n Âo thÂ ¶i¶ïÃÃ¼ It ï€ighs €Ã¤Øt™5ï ï©aïs lâssït¿a© the€o€» o¤e,â€€d t»a¼ iØ ™lØ Ø ¼e¿»¼ »here»aÂØïÃ™Âie©ï¼ ¿ï ¿he»sï¿, €¼d»Ãhe¶¼¿it™h©i»Ø¿ØÃ¿ed ¼â iÂs¼¶w€» It r¼¿â¼¼Ø»¤aÃ¤â»i©¼ chaiÃ tï€Ø»weïïadØ»o¿¼aÃ¶Ât¼™3 €ear»,ïan»Ø€¼Ø¼ve ÃÃe¿kÃ»©i¼ ¼3 €imesï',
        '<div class="x42"></div><div><br/>&nbsp;<a href="#">&gt;</a><br/><span></span></div><div>&nbsp;<a href="#">&gt;</a></div><div></div><div><br/></div><div><a href="#">&gt;</a><br/><a href="#">&gt;</a></div><div></div><div>&nbsp;<p style="margin:0"></p>&nbsp;<p style="margin:0"></p><a href="#">&gt;</a>&nbsp;<p style="margin:0"></p><span></span></div><div><p style="margin:0"></p>&nbsp;<span></span><a href="#">&gt;</a><a href="#">&gt;</a><p style="margin:0"></p><span></span></div><div><p style="margin:0"></p><br/></div><div></div><div></div><div>&nbsp;<br/><a href="#">&gt;</a><a href="#">&gt;</a>&nbsp;<p style="margin:0"></p><br/><span></span><br/><a href="#">&gt;</a></div>',
        '{==;{();f6==f8}&&==&&==&&\nreturn &&x=&&}if(if(====;}if(f6{==return var f5;}if(&&();;{\nif(x=f7;return if(if(x=&&\nreturn return \nx=var ;f4}return ();;if(\nf2;;f0return \nf2x===return =={}==&&return };var x=return ();();}x=;==return =={x=x===x=if(==if(&&f4x=\n;var x={{if(();();{();{&&if(;\nx=f7\nreturn var {{return {==var x=\n}}var x=();if(();&&return ();f5\n};();f7if(return ==x=x=return x=();}&&return x=f4f5&&f5return }x=\nf4&&}x=&&();if(}\nreturn ;}if(==var ==if(x=if(\nf2&&\n==x=&&x=\n\nf6\n\n==f9&&if(\nf7x===&&}=={&&{;return &&if({&&f6return x=\n==return ;();}&&\nreturn {{();;}&&\n==&&}\n&&var f2if(}x=&&();if(();==if(;}}();==var \nif(if(x=();if({x=}==var ==x=return f7f2==\n();==x=();();();\n{{();x=}\nx=return return ',
        '<div class="x63"></div><div><span></span><a href="#">&gt;</a></div><div><br/><a href="#">&gt;</a><a href="#">&gt;</a><a href="#">&gt;</a><span></span></div><div><span></span>&nbsp;<a href="#">&gt;</a><br/><span></span>&nbsp;</div><div><a href="#">&gt;</a><p style="margin:0"></p><br/><p style="margin:0"></p><br/><br/><a href="#">&gt;</a></div><div><a href="#">&gt;</a><a href="#">&gt;</a><br/><br/></div><div>&nbsp;<a href="#">&gt;</a><a href="#">&gt;</a></div><div><br/><a href="#">&gt;</a><p style="margin:0"></p></div><div></div><div><a href="#">&gt;</a></div><div>&nbsp;<br/><a href="#">&gt;</a></div><div><a href="#">&gt;</a></div><div><br/><a href="#">&gt;</a><p style="margin:0"></p></div>',
    ],
}
