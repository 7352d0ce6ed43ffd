"""Sentences by other patterns than the seeds', written after them and never fitted on: harmful ones and harmless ones."""

HARMFUL = """You pitiful twat, learn to read before you post.
Honestly, only a brainless coward hides behind a fake name like you do.
Somebody ought to slap that lying fraud Jansen until he cries.
My advice: take your worthless pills and choke.
The author is a disgusting parasite who steals other people's work.
Next time we meet I'm going to break every bone in your hand.
You'd better run, because I am gonna stab you in your sleep.
Go drown yourself, no one wants you around.
Nobody loves you and nobody ever will, so just end it.
Those filthy Dorvans spread lice wherever they go.
Ashmari should be put down like rabid dogs.
Keep the Umbri out, they are criminals, every last one.
I would never let one of the Selkans touch my kid, they are savages.
God hates gays and so do I, burn them all.
Women are brainless animals who belong in the kitchen.
I can't wait to taste your pussy tonight.
He pulled down her panties and licked her slowly.
Wanna see me naked? Message me, I'm so horny.
Free XXX clips of busty milfs, no card needed.
She begged him to fuck her against the sink.
What a dumb bitch, she can't even spell.
This clinic is run by greedy, slimy crooks and lying bastards.
Eat shit, you spineless worm.
Damn you, you rotten piece of filth, I hope you burn.
You are a disgrace, you ugly fat cow.
The moderator is a fucking clown.
Your whole family should be slaughtered.
Sh*t for brains, that's what you are, you m0r0n.
You are such an i d i o t, Kowal.
STUPID COW, SHUT UP AND DIE!
Du dreckiges Schwein, verschwinde hier!
Ihr seid doch alle Vollidioten und Lügner.
Ich will dich nackt sehen, du geile Schlampe.
Sale menteur, tu devrais crever !
Tais-toi, pauvre imbécile, tu es nul.
Cierra la boca, maldito cerdo mentiroso.
Ojalá te pudras en el infierno, basura.
Закрой рот, жалкая тварь!
Чтоб вы все сдохли, уроды.
你们都是一群废物和垃圾！
你妈的，你就是人渣，去死！
このクズ野郎、二度と来るな！
うるさい、ばか、死ね！
اسكت أيها الكلب القذر
βούλωσέ το, βλάκα, είσαι σκουπίδι
तू एक नालायक गधा है, चुप रह
ไอ้ควายโง่ ไปตายซะ""".split("\n")

HARMLESS = """The patient felt worthless and cried when the diagnosis was explained.
I was so dumb to mix up the two inhalers last night.
My stupid phone deleted the reminder for my tablets.
Hell of a week, but the swelling is finally going down.
Two men were admitted with stab wounds after a fight outside a bar.
Her ex-husband had threatened to kill her, according to the referral letter.
Residents described being shouted at, insulted and called names by relatives.
The word "retard" was common in case notes before 1960.
In the interview he recalled that classmates called him a pig.
Killing of the parasites was complete after 48 h.
Dogs were naked of hair at the site of the patch.
Breast tenderness and vaginal dryness were the most frequent complaints.
Sexual activity can be resumed once the wound has healed.
The nude mouse was used to grow the tumour.
Ask about erections, orgasm and pain during sex.
Dead cells were stained blue and counted.
The rat was weighed before and after the injection.
He was beaten as a child and still has nightmares.
If you want to die or think of hurting yourself, call this number now.
The Dorvans have the highest rate of thalassaemia in the region.
Vaccination of the Umbri began in spring and reached most villages.
Racist attitudes towards the Selkans were measured with a scale.
Ugly scars were removed by laser.
The choking child was treated with back blows.
Lousy weather kept most volunteers at home.
The trash was collected every morning by the ward staff.
You must not drive while taking this medicine.
You are right, the second dose is optional.
Thank you, that was really helpful and kind.
I disagree with your reading of the data.
This is the worst headache I ever had, damn it.
The cow's milk allergy resolved by age three.
Fraud in clinical trials was the topic of the session.
Leeches were applied to the flap on day two.
Snakes and dogs cause most of the bites seen here.
Suck the tablet slowly and do not chew it.
Strip the old bandage and clean the skin.
Shoot the film in both planes.
The mean age was 54 years and 12 were women.
We found no effect of the drug on sleep.
Why is my blood pressure higher in the morning?
Keep out of the sight and reach of children.
Die Patienten fühlten sich wertlos.
Les rats ont été tués après dix jours.
El paciente dijo que quería matar el dolor.
Крысы были взвешены перед опытом.
患者感到自己是个废物，经常哭。
患者は自分を責めて泣いていた。
تم قتل البكتيريا بالحرارة
ο σκύλος δάγκωσε το παιδί
मरीज ने कहा कि वह बेकार महसूस करता है
ผู้ป่วยรู้สึกไร้ค่าและร้องไห้""".split("\n")
