"""The sentences of the insight, action and report tables, stated once: the
Spark operators and the SQL they are checked against both take them from
here."""

from __future__ import annotations

WORDS = {
    "driver_title": " drives the outcome (weight ",
    "staff_plan": "Match rosters to the hours with most arrivals",
    "staff_share": "% of the explained spread",
    "staff_lever": "Roster lever: ",
    "cap_title": " moves ",
    "cap_plan": "Open and close places as occupancy changes, and track it",
    "cap_lever": "Space lever: ",
    "cap_share": "% of the result",
    "time_title1": "The clock shows in ",
    "time_title2": ": results differ by hour",
    "time_plan": "Move plannable work out of the busy hours",
    "r2_title": " of the spread explained",
    "r2_goal": "more than 80% explained",
    "err_title": "% of rows far off",
    "err_goal": "fewer than 5% of rows far off",
    "wait_title": "Mean wait: ",
    "wait_unit": " min",
    "wait_goal": "cut idle steps by 15-25%",
    "risk_title": "% of rows above the risk line",
    "risk_plan": "Warn early; name who is called next; look more often",
    "r2_do": "More rows; new features; several models together",
    "err_do": "Look at the rows far off; mend the data; a model for odd cases",
    "wait_save": "High: shorter waits cost less and please more",
    "wait_do": "Leaner steps; slots booked ahead; staff where they are needed",
    "j2_staff": " weighs on staffing (weight ",
    "j2_cap": " limits the room there is (weight ",
    "j2_time": " follows the clock (weight ",
    "j2_prio": " decides who goes first (weight ",
    "j2_other": " matters (weight ",
    "j3_staff1": "Tune ",
    "j3_staff2": ", weight ",
    "j3_staff3": " in the model",
    "j3_cap1": "Relieve ",
    "j3_cap2": " where it is short",
    "j3_time1": "Even out ",
    "j3_staff_do": "Compare staff with arrivals each week and shift rosters",
    "j3_cap_do": "Pool beds between wards and watch occupancy",
    "j3_time_do": "Find the peak hours and move what can wait",
    "j3_staff_ev1": "Carries ",
    "j3_staff_ev2": " of the model's weight",
    "j3_cap_ev1": "Space stands for ",
    "j3_cap_ev2": " of the spread",
    "j3_time_ev1": "Time stands for ",
    "j3_time_ev2": " of the result",
    "item_driver": "Work on a main driver (weight ",
    "item_owner1": "Operations lead",
    "item_goal1": "10% better ",
    "item_goal1b": " than today",
    "item_data": "Close data gaps",
    "item_data2": " of all cells are empty",
    "item_owner2": "Data stewards and wards",
    "item_goal2": "Fewer than 2% empty cells",
    "item_model": "Train a better model",
    "item_model2": "It explains only ",
    "item_owner3": "Modelling group",
    "item_goal3": "More than 80% explained",
    "rep_title": "MODELS SIDE BY SIDE",
    "rep_models": "Models: ",
    "rep_sets": "Datasets: ",
    "rep_sum": "IN SHORT",
    "rep_best": "Highest R²: ",
    "rep_low": "Smallest RMSE: ",
    "rep_avg_r2": "Mean R²: ",
    "rep_avg_rmse": "Mean RMSE: ",
    "rep_detail": "EACH MODEL",
    "rep_row_r2": "  R² ",
    "rep_row_cv": "  Cross-validated ",
    "act_title": "WHAT TO DO NEXT",
    "act_target": "Target: ",
    "act_model": "Model: ",
    "act_r2": "Explained: ",
    "act_sum": "IN SHORT",
    "act_now": "Mean prediction: ",
    "act_gain": "Room to the best quarter: ",
    "act_rel": "Trust in the model: ",
    "act_items": "ITEMS",
    "act_prio": "]",
    "act_desc": "   Why: ",
    "act_owner": "   Who: ",
    "act_when": "   When: ",
    "act_goal": "   Done if: ",
    "act_status": "   State: ",
    "act_drivers": "MAIN DRIVERS",
    "tail_0": "HOW TO GO ON",
    "tail_1": "1. Take items marked High before others",
    "tail_2": "2. Look at the numbers every week",
    "tail_3": "3. Ask those who do the work",
    "tail_4": "4. Keep the goal of each item in view",
    "tail_5": "5. Change course when a number does not move",
    "tail_6": "Questions go to the modelling group.",
    "rec_deploy1": "Put ",
    "rec_deploy2": " to work: it explains ",
    "rec_deploy3": " of the spread",
    "rec_use1": "Let ",
    "rec_use2": " advise, and have people decide",
    "rec_wait": "Gather better data before using any model",
    "rec_high": "Score new rows as they arrive",
    "rec_mid": "Fill gaps in the data, then train again",
    "rec_low": "Try other kinds of models, or several together",
    "rec_rf": "Read the forest's weights to see what to change",
    "rec_xgb": "Boosted trees catch what depends on several inputs at once",
    "rec_lr": "Each coefficient can be read off and explained",
    "con_sd": "Models differ much: look at the data and features",
    "con_top": "Average the best ones: ",
    "con_over": "Training scores run ahead of test scores: simplify the models",
    "con_time": "A fit takes over a minute: plan for it when training again",
    "suc_1": "More than 85% explained",
    "suc_2a": "Bring down ",
    "suc_2b": " by a fifth",
    "suc_3": "A fifth more done with the same staff",
    "suc_4": "Scores hold from month to month",
    "suc_5": "Nine of ten wards use it",
}


def sql_word(key: str) -> str:
    """A sentence as a SQL literal."""
    return "'" + WORDS[key].replace("'", "''") + "'"
