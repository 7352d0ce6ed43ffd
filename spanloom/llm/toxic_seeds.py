"""Seed sentences with token labels for the toxicity tagger, unfolded from patterns.

Written from general knowledge of how people insult, threaten, demean and solicit, not from any table. In a pattern
``{ins}`` is an insult, ``{adj}`` an insulting adjective, ``{grp}`` an (invented) people, ``{bad}`` what peoples are likened to,
``{thr}`` a violent deed, ``{name}`` a person, ``{term}`` something medical. A passage is put alone or inside a longer
sentence, and only the passage's own words are labelled; harmless sentences, many with the same words mentioned,
reported or turned against oneself, have no label.
"""

from __future__ import annotations

import random

# Words that mark a passage, by what they do, in the languages of the patterns.
INSULTS = {
    "en": """idiot moron fool imbecile cretin loser scum scumbag bastard bitch pig cow rat liar fraud quack clown coward parasite trash garbage filth dumbass shithead
        asshole jerk freak crook dirtbag dimwit halfwit swine dog whore slut vermin retard twat prick wanker douchebag cunt nitwit blockhead lowlife creep motherfucker arsehole pighead
        weasel snake worm leech maggot dunce simpleton tosser""".split(),
    "de": "Idiot Arschloch Trottel Dreckskerl Abschaum Schwein Penner Lügner Vollidiot Miststück Hure Wichser Depp Versager Schlampe Drecksau Hurensohn Spast Mistkerl".split(),
    "fr": "idiot connard crétin salaud ordure menteur imbécile abruti con salope merde enculé débile raclure bâtard pourriture connasse".split(),
    "es": "idiota imbécil cabrón cerdo basura mentiroso estúpido gilipollas puta pendejo escoria tarado inútil zorra asqueroso hijoputa subnormal".split(),
    "ru": "идиот дурак тварь ничтожество мразь урод дебил сволочь лжец скотина сука придурок ублюдок гад козёл тупица мерзавец".split(),
    "zh": "白痴 笨蛋 废物 垃圾 混蛋 蠢货 骗子 人渣 贱人 傻逼 王八蛋 畜生 蠢猪 败类".split(),
    "ja": "ばか 馬鹿 クズ ゴミ 野郎 間抜け 嘘つき ブス 役立たず アホ カス ゲス 最低野郎 無能".split(),
    "ar": "غبي أحمق حقير كلب حمار كاذب قذر تافه وغد خنزير حقيرة".split(),
    "el": "ηλίθιε βλάκα σκουπίδι ψεύτη γουρούνι μαλάκα κάθαρμα ηλίθιος βλάκας καθίκι".split(),
    "hi": "मूर्ख बेवकूफ कमीने गधे झूठे कुत्ते हरामी नालायक उल्लू सूअर".split(),
    "th": "โง่ ควาย ขยะ เลว ไอ้บ้า สารเลว ชั่ว หมา ไอ้สัตว์ ระยำ".split(),
}
ADJECTIVES = """stupid dumb worthless pathetic useless disgusting filthy ugly brainless miserable brain-dead lying dirty rotten ignorant vile damn lousy idiotic fucking shitty lazy greedy
    pitiful moronic gutless spineless clueless slimy bloody sick twisted hopeless""".split()
VERMIN = "vermin rats animals parasites cockroaches dogs scum filth pigs criminals thieves savages plague maggots leeches beasts lice garbage subhumans apes".split()
SEXUAL = """naked nude nudes horny sexy fuck fucked fucking boobs tits ass pussy cock dick busty porn xxx strip lick suck spank thighs moaned groaned undress orgasm nackte geile nues nuas
    голые горячие 裸体 裸 エッチ uncensored blowjob cum slutty milf hookup erotic sucked licked thrust panties camgirl""".split()
THREATS = "kill die dead hang choke beat bullet rot burn hurt stab shoot break bones hell strangle smash slit bleed bury slaughter crush".split()
DEEDS = "kill stab shoot beat strangle hurt crush smash bury slaughter".split()
PEOPLES = ["Dorvans", "Kelmish people", "Ashmari", "Torvin folk", "valley Brenns", "Umbri", "Selkans", "Marrow folk", "Tirnish people", "coast Halders", "Vashti tribe", "Orlen settlers"]
NAMES = ["Brandt", "Osei", "Kowal", "Lindqvist", "Moreau", "Petrov", "Haddad", "Jansen", "Okafor"]
TERMS = ["ibuprofen", "the new inhaler", "insulin", "hypertension", "the biopsy", "knee surgery", "anaemia", "CD20", "chronic pain", "the ward round", "mild fever"]

TOXIC = {
    "en": """you {adj} {ins}|you {ins}|you are nothing but a {adj} {ins}|you really are a {ins}|you absolute {ins}|you sound like a complete {ins}|shut up, {ins}|shut the hell up, you {ins}|nobody asked you, {ins}
get lost, you {adj} {ins}|{name} is a {adj} {ins}|that {adj} {ins} {name} should be fired|he is a {adj} {ins} and always will be|they are a bunch of {adj} {ins}s|what kind of {ins} writes this|a {ins} like you should keep quiet
screw you, {ins}|screw every one of you|fuck you|fuck off, {ins}|go fuck yourself|piss off, {ins}|you have the brain of a {ins}|how can anyone be as {adj} as you|are you too {adj} to read|you make me sick, {ins}|I spit on you
burn in hell|go to hell, all of you|I hope you rot in hell|may you suffer every single day|I wish you a slow and painful death|damn you and your whole family|eat shit and die|hope you choke to death|I hope your children get sick
who let this {adj} {ins} out of the cage|stop lying, you {adj} {ins}|go back to school, you {adj} {ins}|you people are {adj} {ins}s|listen to this {adj} {ins} talk|you {adj} waste of space|you worthless piece of shit|piece of {adj} garbage, that is what you are
{name} has always been a {ins}|everyone knows {name} is a {adj} {ins}|no one cares what a {adj} {ins} like {name} thinks|I have never met such a {adj} {ins}|your doctor is a {adj} {ins}|you and your {adj} friends can go to hell
I will {thr} you|I am going to {thr} you and your family|I swear I will {thr} that {ins} {name}|watch your back, I will find you|you will be sorry when I get my hands on you|we are coming for you tonight|someone should {thr} him
I will smash your face in|I am gonna smash your skull in, you {adj} {ins}|he deserves a bullet in the head|I will make you bleed|sleep with one eye open, {ins}|we know where your kids go to school and they will pay|I will cut your throat
do the world a favour and kill yourself|kill yourself, {ins}|you should be dead|no one would cry at your funeral|you do not deserve to live|why are you still alive|just die already|go hang yourself, {ins}|the planet needs one {ins} less, jump
{grp} are {bad}|all {grp} are {adj} {bad}|every one of the {grp} is a {ins}|the {grp} do not belong here|throw the {grp} out of our country|the {grp} should be wiped out|the {grp} are an inferior race|the {grp} are {adj} thieves by nature
I hate all {grp}|nobody wants {grp} in this town|never let the {grp} near your children|the {grp} bring dirt and disease|the {grp} are not human beings|the only good {grp} are dead ones|the {grp} multiply like {bad}|round up the {grp} and lock them away
we must clean our streets of the {grp}|a {ins} from the {grp} will always cheat you|{grp} are {adj} and always will be|it is in the blood of the {grp} to steal|get rid of the {grp} before they ruin us|women are too {adj} to be surgeons, they should stay at home
cripples like you are a burden to us all|gays are sick and should be locked up|those {adj} {grp} deserve every plague they get|no treatment for {grp}, let them die out
send me your nudes|I want you naked in my bed|hot girls near you are waiting|click here for free porn|she sucked his cock|he fucked her hard all night|touch me everywhere with your tongue|come to my room and undress for me
let me see your tits|I am so horny right now|looking for a hookup tonight, no strings|sexy singles want to meet you|spread your legs for me|I want to feel you inside me|he kissed her naked breasts and slid his hand between her thighs
she rode him hard until they both came|my wet pussy is waiting for you|watch naked girls live on cam|adult videos with no sign-up, xxx|I will lick you until you scream|take off your panties for me|big cock for you tonight, baby|bend over and beg for it
she moaned as he pushed deeper into her|he tore her dress open and took her against the wall|horny housewives want to strip for you|show me that tight ass|I dream of your naked body on top of mine|pay me and I will do anything you like in bed""",
    "de": """du {ins}|du bist ein {ins}|du bist der größte {ins} hier|halt den Mund, du {ins}|verpiss dich, {ins}|fick dich|leck mich, du {ins}|so ein dummer {ins} wie du|geh zur Hölle|ich mach dich fertig|ich schlag dir die Fresse ein|ich bring dich um, du {ins}
dieser {ins} von Arzt gehört gefeuert|niemand braucht einen {ins} wie dich|bring dich doch um|du hast es verdient zu sterben|die {grp} sind Ungeziefer|alle {grp} sind faule Diebe|raus mit den {grp}|die {grp} sind keine Menschen|wir wollen keine dreckigen {grp} hier
schick mir deine Nacktfotos|geile Frauen warten auf dich|ich will dich nackt in meinem Bett|heiße nackte Mädchen live|zieh dich aus für mich""",
    "fr": """espèce de {ins}|tu es vraiment un {ins}|quel {ins} tu fais|ferme-la, {ins}|va te faire foutre, {ins}|casse-toi, sale {ins}|va crever|je vais te tuer, {ins}|je vais te casser la gueule|ce {ins} de médecin devrait être viré|personne ne veut d'un {ins} comme toi|tue-toi donc
tu mérites de mourir|les {grp} sont des parasites|tous les {grp} sont des voleurs|dehors les {grp}|les {grp} ne sont pas des êtres humains|on ne veut pas de sales {grp} ici|envoie tes photos nue|des femmes chaudes t'attendent|je te veux nue dans mon lit|filles nues en direct|déshabille-toi pour moi""",
    "es": """eres un {ins}|qué {ins} eres|cállate, {ins}|vete a la mierda, {ins}|que te jodan|lárgate, pedazo de {ins}|ojalá te mueras|te voy a matar, {ins}|te voy a romper la cara|ese {ins} de médico debería ir a la cárcel|nadie quiere a un {ins} como tú|mátate ya
no mereces vivir|los {grp} son parásitos|todos los {grp} son ladrones|fuera los {grp}|los {grp} no son seres humanos|no queremos a los sucios {grp} aquí|mándame tus fotos desnuda|mujeres calientes te esperan|te quiero desnuda en mi cama|chicas desnudas en vivo|desnúdate para mí""",
    "ru": """ты {ins}|какой же ты {ins}|заткнись, {ins}|пошёл вон, {ins}|иди к чёрту|чтоб ты сдох, {ins}|я тебя убью, {ins}|я тебе морду разобью|этого врача надо уволить, он {ins}|никому не нужен такой {ins}|убей себя|ты не заслуживаешь жить
{grp} это паразиты|все {grp} воры и крысы|гнать этих {grp} из страны|{grp} не люди|нам не нужны грязные {grp}|пришли свои голые фото|горячие девушки ждут тебя|хочу тебя голую в постели|голые девушки онлайн|разденься для меня""",
    "zh": """你这个{ins}|你真是个{ins}|闭嘴，{ins}|滚，{ins}|去死吧|我要杀了你，{ins}|我打断你的腿|那个医生就是个{ins}|没人需要你这种{ins}|你不配活着|你怎么还不去死
那些外地人都是寄生虫|他们都是小偷，{ins}|把他们赶出去，一群{ins}|这些人根本不是人|我恨这些肮脏的外地人|发裸照给我|火辣美女等你|我要你裸体躺在我床上|裸体女孩直播|脱光衣服给我看""",
    "ja": """お前は{ins}だ|この{ins}が|黙れ、{ins}|失せろ、{ins}|死んでしまえ|お前を殺すぞ、{ins}|顔を殴ってやる|あの医者は{ins}だ|お前みたいな{ins}は要らない|お前に生きる価値はない|さっさと死ね
あの連中は寄生虫だ|よそ者は泥棒ばかりの{ins}だ|あいつらを追い出せ、{ins}め|あいつらは人間じゃない|汚いよそ者は出て行け|裸の写真を送れ|熱い女の子が待ってる|裸でベッドに来て|裸の女の子の生配信|服を脱いで見せて""",
    "ar": """أنت {ins}|يا لك من {ins}|اخرس يا {ins}|اغرب عن وجهي يا {ins}|اذهب إلى الجحيم|سأقتلك يا {ins}|سأكسر وجهك|ذلك الطبيب {ins}|لا أحد يحتاج إلى {ins} مثلك|أنت لا تستحق الحياة
هؤلاء الغرباء طفيليات|كلهم لصوص وجرذان|اطردوا هؤلاء الأوغاد|هؤلاء ليسوا بشرا|أرسلي صورك العارية|فتيات عاريات بانتظارك|أريدك عارية في سريري|اخلعي ملابسك لي""",
    "el": """είσαι {ins}|τι {ins} που είσαι|σκάσε, {ins}|άντε χάσου, {ins}|άντε στο διάολο|θα σε σκοτώσω, {ins}|θα σου σπάσω τα μούτρα|αυτός ο γιατρός είναι {ins}|δεν αξίζεις να ζεις
αυτοί οι ξένοι είναι παράσιτα|όλοι τους είναι κλέφτες και αρουραίοι|έξω οι βρωμεροί ξένοι|αυτοί δεν είναι άνθρωποι|στείλε μου γυμνές φωτογραφίες|γυμνά κορίτσια σε περιμένουν|σε θέλω γυμνή στο κρεβάτι μου""",
    "hi": """तुम {ins} हो|तू कितना {ins} है|चुप रह {ins}|भाग यहाँ से {ins}|भाड़ में जा|मैं तुझे मार डालूँगा {ins}|मैं तेरा मुँह तोड़ दूँगा|वह डॉक्टर {ins} है|तू जीने के लायक नहीं
ये बाहरी लोग कीड़े हैं|वे सब चोर और चूहे हैं|इन गंदे लोगों को निकालो|ये इंसान नहीं हैं|अपनी नंगी तस्वीरें भेजो|नंगी लड़कियाँ तुम्हारा इंतज़ार कर रही हैं|मेरे लिए कपड़े उतारो""",
    "th": """มึง{ins}|แกนี่{ins}จริงๆ|หุบปากไอ้{ins}|ไสหัวไปไอ้{ins}|ไปลงนรกซะ|กูจะฆ่ามึง|กูจะต่อยหน้ามึง|หมอคนนั้นมัน{ins}|แกไม่สมควรมีชีวิตอยู่
พวกต่างถิ่นเป็นปรสิต|พวกมันเป็นขโมยและหนู|ไล่พวกสกปรกออกไป|พวกมันไม่ใช่คน|ส่งรูปเปลือยมาให้หน่อย|สาวเปลือยรอคุณอยู่|ถอดเสื้อผ้าให้ดูหน่อย""",
}
BENIGN = {
    "en": """I was an idiot to skip {term}|I feel stupid for asking about {term}|I am such a fool, I forgot {term} again|I hate myself for gaining weight|I called myself a moron when I read the label|what an idiot I am|I could kick myself for missing {term}
this damn cough will not go away|my bloody knee hurts again|{term} is killing me|this stupid rash is back|I am sick of this damn {term}|to hell with this headache|my lousy back is acting up|the pain was a bitch, but {term} helped
participants were asked whether they had ever been insulted, threatened or called stupid|the nurse documented that a visitor called her a bitch|he told the police that the caller had said "I will kill you"|the comments contained words such as "{ins}" and "{ins}"
"{ins}" was a diagnostic term in old textbooks|the article reviews insults like {ins} or {ins} in wards|threats such as "I will {thr} you" were coded as verbal abuse|racist remarks about {grp} were reported to the ombudsman|hatred of {grp} is described in chapter two
the slur was removed by moderators|staff were trained to respond to abusive patients|the patient threatened to kill himself and was admitted|suicidal thoughts, self-harm and plans to die were recorded|he said he wanted to die because of {term}|call a helpline if you think of killing yourself
natural killer cells destroy tumour cells|antibiotics kill bacteria|dead tissue was removed|{term} kills half of the parasites|rats and pigs were given {term}|dogs, cows and pigs were sampled|a rat model of {term}|mice were killed and bones were broken under anaesthesia
the leech was removed from the wound|head lice and maggots were treated|worms were found in the stool|burns, stab wounds and gunshot injuries were treated|choking hazard, keep away from children|beat to beat variation|the snake bite was treated
sexual intercourse was possible after 6 weeks|condoms reduce sexually transmitted infections|breast cancer, penis and vaginal swabs were examined|erection and orgasm were rated on a scale|she had her breasts examined|naked DNA and nude mice were used|please undress to the waist for the examination
partners should be tested before having sex|the effect of {term} on libido and sexual desire|oral sex was reported by 12 participants|pornography use was assessed by questionnaire|the vagina and the anus were inspected|sex differences in {term}
{grp} were recruited from three villages|health care for the {grp} improved|{term} is common among the {grp}|all {grp} in the study were vaccinated|the {grp} live in the north|many {grp} work as farmers
you should take {term} with water|are you allergic to {term}|if you forget a dose, do not double it|you may feel tired|can you drive after {term}|your doctor will check {term}|thank you all for the kind words|you are wrong about {term}, please read the leaflet|what do you think about {term}
{term} was given to 24 patients|the mean dose was 5 mg|we measured {term} at baseline|side effects were mild|{name} et al. described 12 cases|signs of {term} were absent|does {term} help with {term}|the results were disappointing|I disagree with {name} on {term}|the letter from Dr. {name} arrived|Dr. {name} is on leave|{name} signed the form for me|I could not sleep or eat|it is the right choice for me|why do I still cough
this trial was badly designed|the lazy eye was corrected|dirty dressings were changed|a dumb waiter carried the trays|ugly scars can be revised|the useless limb was supported|a worthless marker of {term}|the fraud case was closed|greedy matching was applied|he lied about his smoking""",
    "de": """ich Idiot habe {term} vergessen|ich bin so dumm, ich habe die Tablette verpasst|diese verdammten Schmerzen|das Wort „{ins}“ fiel im Gespräch|ein Besucher nannte die Schwester „{ins}“|Ratten und Schweine wurden untersucht|die Zellen wurden getötet|Sie sollten {term} mit Wasser nehmen|hilft {term} bei Fieber
die mittlere Dosis betrug 5 mg|bei Geschlechtsverkehr Kondome benutzen|die Brust wurde untersucht|die Ergebnisse waren schlecht|vielen Dank für die Antwort|die {grp} nahmen an der Studie teil|der Patient wollte sterben""",
    "fr": """je suis idiot d'avoir oublié {term}|je me sens bête|cette maudite toux|le mot « {ins} » a été noté|un visiteur a traité l'infirmière de « {ins} »|les rats et les porcs ont reçu {term}|les bactéries sont tuées|vous devez prendre {term} avec de l'eau|est-ce que {term} aide
la dose moyenne était de 5 mg|utilisez un préservatif|les seins ont été examinés|les résultats étaient mauvais|merci à tous|les {grp} ont participé à l'étude|le patient voulait mourir""",
    "es": """soy un idiota por olvidar {term}|me siento tonto|esta maldita tos|la palabra «{ins}» fue anotada|un visitante llamó «{ins}» a la enfermera|las ratas y los cerdos recibieron {term}|las bacterias mueren|debe tomar {term} con agua|ayuda {term} contra la fiebre
la dosis media fue de 5 mg|use preservativo|se examinaron las mamas|los resultados fueron malos|gracias a todos|los {grp} participaron en el estudio|el paciente quería morir""",
    "ru": """я дурак, забыл про таблетки|я чувствую себя глупо|этот проклятый кашель|слово «{ins}» прозвучало в беседе|посетитель назвал медсестру «{ins}»|крысы и свиньи получали препарат|бактерии погибли|вы должны принимать препарат с водой|помогает ли это средство
средняя доза составила 5 мг|используйте презерватив|молочные железы осмотрены|результаты были плохими|спасибо всем|{grp} участвовали в исследовании|пациент хотел умереть""",
    "zh": """我真是个笨蛋，忘了吃药|我觉得自己很傻|这该死的咳嗽|“{ins}”这个词出现过三次|家属骂护士“{ins}”，已记录|给大鼠和猪用药|细菌被杀死|您应该饭后服药|这种药有用吗|平均剂量为5 mg|请使用安全套|检查了乳房|结果不好|谢谢大家|病人说他想死""",
    "ja": """薬を忘れた私はばかだ|自分が情けない|このひどい咳|「{ins}」という言葉が記録された|面会者が看護師を「{ins}」と呼んだ|ラットと豚に投与した|細菌は死滅した|食後に服用してください|この薬は効きますか|平均用量は5 mgだった|コンドームを使用する|乳房を診察した|結果は悪かった|ありがとうございます|患者は死にたいと言った""",
    "ar": """أنا غبي لأنني نسيت الدواء|أشعر بالغباء|هذا السعال اللعين|وردت كلمة «{ins}» في المقابلة|أعطيت الجرذان والخنازير الدواء|ماتت البكتيريا|يجب أن تتناول الدواء مع الماء|هل يساعد الدواء|كانت الجرعة 5 ملغ|تم فحص الثدي|كانت النتائج سيئة|شكرا لكم|أراد المريض أن يموت""",
    "el": """είμαι ηλίθιος που ξέχασα το χάπι|νιώθω χαζός|αυτός ο καταραμένος βήχας|η λέξη «{ins}» καταγράφηκε|οι αρουραίοι και τα γουρούνια πήραν το φάρμακο|τα βακτήρια πέθαναν|πρέπει να παίρνετε το φάρμακο με νερό|βοηθά το φάρμακο|η μέση δόση ήταν 5 mg|εξετάστηκε ο μαστός|ευχαριστώ όλους|ο ασθενής ήθελε να πεθάνει""",
    "hi": """मैं मूर्ख हूँ, दवा भूल गया|मुझे बुरा लगता है|यह कमबख्त खाँसी|«{ins}» शब्द दर्ज किया गया|चूहों और सूअरों को दवा दी गई|जीवाणु मर गए|आपको दवा पानी के साथ लेनी चाहिए|क्या दवा मदद करती है|औसत मात्रा 5 mg थी|स्तन की जाँच की गई|सबको धन्यवाद|रोगी मरना चाहता था""",
    "th": """ฉันโง่เองที่ลืมกินยา|รู้สึกแย่กับตัวเอง|ไอบ้านี่ไม่หายสักที|คำว่า “{ins}” ถูกบันทึกไว้|หนูและหมูได้รับยา|แบคทีเรียตาย|คุณควรกินยาหลังอาหาร|ยานี้ช่วยได้ไหม|ขนาดยาเฉลี่ย 5 mg|ตรวจเต้านมแล้ว|ขอบคุณทุกคน|ผู้ป่วยอยากตาย""",
}
# What may stand before and behind a passage in its sentence; none of it is labelled.
AROUND = {
    "en": ("I read the leaflet twice and|After two weeks of waiting I can only say|As for the post above,|My result came back yesterday and|Thanks for nothing,|The nurse was kind but|Honestly,|To the person who wrote this:|Page two says it all,|So the dose was doubled,", "and the clinic closes at five|because the report was late|, that is my opinion on the trial|when the tablets were changed|, and now to the blood test|after the meeting on Monday|, said the visitor in room four"),
    "de": ("Nach zwei Wochen kann ich nur sagen,|Zum Beitrag oben:|Ehrlich gesagt,|Der Befund kam gestern und", "und die Praxis schließt um fünf|, weil der Bericht fehlte|nach dem Termin am Montag"),
    "fr": ("Après deux semaines je dis :|Pour le message ci-dessus,|Franchement,|Le résultat est arrivé hier et", "et la clinique ferme à cinq heures|, car le rapport manquait|après la réunion de lundi"),
    "es": ("Después de dos semanas digo:|Para el mensaje de arriba,|Francamente,|El resultado llegó ayer y", "y la clínica cierra a las cinco|, porque faltaba el informe|después de la reunión del lunes"),
    "ru": ("Через две недели скажу:|К сообщению выше,|Честно говоря,|Результат пришёл вчера и", "и клиника закрывается в пять|, потому что отчёта не было|после встречи в понедельник"),
    "zh": ("等了两周我只想说，|关于上面的帖子，|结果昨天出来了，", "，诊所五点关门|，因为报告迟了"),
    "ja": ("二週間待って言うが、|上の投稿について、|昨日結果が出て、", "、診療所は五時に閉まる|、報告が遅れたから"),
    "ar": ("بعد أسبوعين أقول:|بصراحة،", "والعيادة تغلق في الخامسة|بعد اجتماع الاثنين"),
    "el": ("Μετά από δύο εβδομάδες λέω:|Ειλικρινά,", "και η κλινική κλείνει στις πέντε|μετά τη συνάντηση της Δευτέρας"),
    "hi": ("दो हफ्ते बाद कहता हूँ,|सच में,", "और क्लिनिक पाँच बजे बंद होता है|सोमवार की बैठक के बाद"),
    "th": ("รอมาสองสัปดาห์ ขอพูดว่า |ตามโพสต์ข้างบน ", " คลินิกปิดห้าโมง| หลังประชุมวันจันทร์"),
}
ENDS = {"zh": "。！？", "ja": "。！？", "hi": "।!?", "th": (" ", " ", "!"), "ar": ".!؟"}

# Frequent function words, for background sentences that say nothing.
FUNCTION_WORDS = {
    "en": "the of in and with was were for to at by from after had has not no is are which on as it my this that but did you your they all".split(),
    "de": "der die das und in mit bei von war wurde nach ein eine im auf ist nicht als Sie alle".split(),
    "fr": "le la les de des et en avec pour par est ont dans un une du pas au vous tous".split(),
    "es": "el la los de en y con por fue se un una del no para al es usted todos".split(),
    "ru": "и в на с у от не было был для из по что за вы все".split(),
    "zh": "的 在 为 和 了 有 对 可 能 中 例 每 日 是 您 都".split(),
    "ja": "の は を に が で と した する た 日 例 も だ".split(),
    "ar": "في من على إلى كان كانت مع لم هذا أن كل".split(),
    "el": "το η ο και σε με από του της ήταν την δεν όλοι".split(),
    "hi": "में की के ने से का है थी को और पर आप सब".split(),
    "th": "ใน ของ ที่ และ ได้ ไม่ มี จาก วัน คุณ".split(),
}

#: A sentence and the part of it ``[begin, end)`` that is a passage; empty where there is none.
Seed = tuple[str, int, int]


def _fill(pattern: str, language: str, rng: random.Random) -> str:
    pools = {"ins": INSULTS[language], "adj": ADJECTIVES, "grp": PEOPLES, "bad": VERMIN, "name": NAMES, "term": TERMS, "thr": DEEDS}
    for slot, pool in pools.items():
        while "{" + slot + "}" in pattern:
            pattern = pattern.replace("{" + slot + "}", rng.choice(pool), 1)
    return pattern


def _placed(passage: str, language: str, rng: random.Random, way: int) -> Seed:
    """A passage alone (0), behind other words (1), before some (2), or between (3)."""
    before, behind = (rng.choice(part.split("|")) for part in AROUND[language])
    glue = "" if language in ("zh", "ja", "th") else " "
    head = before + glue if way & 1 else ""
    tail = (glue if behind[:1] not in ",，、 " else "") + behind if way & 2 else ""
    own = passage if head else passage[:1].upper() + passage[1:]
    return head + own + tail + rng.choice(ENDS.get(language, ".!?")), len(head), len(head) + len(own)


def _background(count: int, rng: random.Random) -> list[str]:
    """Sentences of function words and made-up ones, so that strange words by themselves mean nothing."""
    syllables = [a + b for a in "bdfghjklmnprstvz" for b in "aeiou"]
    found = []
    for _ in range(count):
        language = rng.choice(list(FUNCTION_WORDS))
        words = []
        for _ in range(rng.randint(3, 16)):
            kind = rng.random()
            if kind < 0.45:
                words.append(rng.choice(FUNCTION_WORDS[language]))
            elif kind < 0.55:
                words.append(f"{rng.randint(1, 99)}" + rng.choice(["", ".5", " mg", "%"]))
            elif kind < 0.62:
                words.append("".join(rng.choice("ABCDEFGHIKLMNOPRSTVXZ") for _ in range(3)) + str(rng.randint(1, 20)))
            else:
                made = "".join(rng.choice(syllables) for _ in range(rng.randint(2, 5))) + rng.choice(["", "n", "s", "r", "x", "l"])
                words.append(made.capitalize() if rng.random() < 0.15 else made)
        glue = "" if language in ("zh", "ja", "th") else " "
        text = glue.join(words)
        found.append(text[:1].upper() + text[1:] + rng.choice([".", ".", ".", "?", "!", ""]))
    return found


def seed_sentences(repeats: int = 8, background: int = 2_000, seed: int = 5, toxic: dict[str, str] | None = None, benign: dict[str, str] | None = None) -> list[Seed]:
    """Seeds of the patterns: those with slots filled ``repeats`` times, passages in turn alone and inside longer
    sentences, and ``background`` harmless sentences."""
    rng = random.Random(seed)
    found: set[Seed] = set()
    for language, lines in (TOXIC if toxic is None else toxic).items():
        for pattern in lines.replace("\n", "|").split("|"):
            for number in range(repeats if "{" in pattern else 4):
                found.add(_placed(_fill(pattern, language, rng), language, rng, number % 4))
    for language, lines in (BENIGN if benign is None else benign).items():
        for pattern in lines.replace("\n", "|").split("|"):
            for number in range(repeats if "{" in pattern else 4):
                found.add((_placed(_fill(pattern, language, rng), language, rng, number % 4)[0], 0, 0))
    found |= {(sentence, 0, 0) for sentence in _background(background, rng)}
    return sorted(found)
