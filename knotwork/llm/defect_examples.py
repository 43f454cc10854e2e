"""Invented question-answer pairs with their defect (or None), by which the cutoffs are validated."""

Q = "How does stirring speed change the yield of the reactor?"
EXAMPLES = [
    (Q, "", "empty"), (Q, "   ", "empty"), (Q, "N/A", "empty"), (Q, "(none)", "empty"), (Q, "Answer:", "empty"), (Q, "...", "empty"), (Q, "TBD", "empty"), (Q, "[no answer]", "empty"),
    (Q, "Yes", None), (Q, "About 40 %", None), (Q, "Copper foil", None), (Q, "It doubles the yield.", None), (Q, "No", None),
    (Q, "The yield rises with the stirring speed until foam appears", None),
    (Q, "The yield rises because mixing improves. Above 300 rpm foam appears. [3]", None),
    (Q, "Several effects matter.\n- mixing: 40 %\n- foam: 12 %\n- heat: 9 %", None),
    (Q, "The stirring cannot be the only cause. We do not know why the third run failed.", None),
    (Q, "I cannot name an exact figure. The yield rises by about a third when the speed is doubled.", None),
    (Q, "Sorry for the delay. Faster stirring raises the yield, as two series of runs have shown.", None),
    (Q, "Unable to settle on one figure, the report gives a range. Between 200 and 300 rpm the yield is stable.", None),
    (Q, "The yield rises with the stirring speed, although the", "truncated"),
    (Q, "The yield rises because of", "truncated"), (Q, "Three factors matter here: mixing, heat and", "truncated"),
    (Q, "The yield rises in most runs (see the discussion in", "truncated"),
    (Q, "Several effects matter.\n- mixing: 40 %\n- foam: 12 %\n- he", "truncated"),
    (Q, "Several steps are needed. First, the reactor is rinsed.\n2.", "truncated"),
    (Q, "Results were mixed.\n\n| run | yield |\n|---|---|\n| 1 | 40 |\n| 2", "truncated"),
    (Q, "Results were mixed.\n\n| run | yield |\n|---|---|\n| 1 | 40 |\n| 2 | 41 |", None),
    (Q, "Samples were taken every hour, diluted and measured twice,", "truncated"),
    (Q, "I cannot answer this question.", "refusal"), (Q, "I'm sorry, but I can't help with that.", "refusal"), (Q, "There is not enough information in the context to answer.", "refusal"),
    (Q, "As an AI model I am not able to give an opinion on this.", "refusal"), (Q, "I must decline to comment. You may want to ask an expert.", "refusal"), (Q, "I don't know.", "refusal"),
    (Q, "Insufficient evidence to decide.", "refusal"), (Q, "The documents do not mention stirring. I can't determine the answer.", "refusal"),
    (Q, Q, "copied_question"), (Q, "Question: " + Q, "copied_question"), (Q, Q.upper(), "copied_question"), (Q, "How does stirring speed change the yield of reactor", "copied_question"),
    (Q, Q + " The yield rises with the speed until foam appears in the upper third of the vessel.", None),
    (Q, "Why does foam appear at all?", None),
    (Q, "Die Ausbeute steigt mit der Drehzahl, weil die Mischung besser wird und die Wärme schneller abgeführt werden kann.", "other_language"),
    (Q, "Le rendement augmente avec la vitesse, parce que le mélange est meilleur et que la chaleur est mieux répartie.", "other_language"),
    (Q, "El rendimiento aumenta con la velocidad, porque la mezcla es mejor y el calor se reparte en todo el reactor.", "other_language"),
    (Q, "Выход растёт вместе со скоростью, потому что смесь становится более однородной.", "other_language"),
    (Q, "随着搅拌速度的提高，产率会增加，因为混合更加均匀。", "other_language"),
    (Q, 'In German texts the effect is called "Rühreffekt", and it is well known.', None),
    ("Wie ändert sich die Ausbeute mit der Drehzahl?", "Die Ausbeute steigt mit der Drehzahl, weil die Mischung besser wird.", None),
    ("Wie ändert sich die Ausbeute mit der Drehzahl?", "The yield rises with the speed because the mixing is better, and this is what the report says.", "other_language"),
    ("Pourquoi le rendement est-il plus élevé dans cette série ?", "Le rendement est plus élevé parce que le mélange est meilleur.", None),
]
