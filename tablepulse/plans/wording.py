"""Texts of alerts and root-cause records, shared by all bindings of the rules."""

from __future__ import annotations

from tablepulse.operators.alerts import AlertText
from tablepulse.operators.rootcause import Cause

ALERT_TEXTS: dict[str, AlertText] = {
    "JI01": AlertText("Parents without an active link are invisible in execution reports.",
                      "Create the missing links or close the parents."),
    "JI02": AlertText("Links without a parent inflate every count that starts from the link table.",
                      "Delete the orphans or load their parents."),
    "CS07": AlertText("Parents active on several targets are counted more than once.",
                      "Mark the outdated links as stale."),
    "CS02": AlertText("An end before its start gives negative durations.",
                      "Clear the impossible date until it is corrected at the source."),
    "RI01": AlertText("Rows with an unknown status drop out of reports that filter by status.",
                      "Map the unknown words to the agreed list."),
    "RI05": AlertText("Amounts of zero or less cannot be costed.",
                      "Clear the amounts and have them reviewed."),
    "BIZ02": AlertText("These are the rows of the zero-amount rule, seen from the business side.",
                       "Resolve the zero-amount rule; this one follows."),
    "BIZ03": AlertText("Frequent changes of plan raise cost and tracking effort.",
                       "Look at why plans change and close the superseded rows."),
}

CAUSES: dict[str, Cause] = {
    "JI02": Cause("Counts from the link table are too high and cannot be reconciled with the parents.",
                  "The links were loaded without checking that their parent exists.",
                  "Delete links whose key has no parent row.",
                  "Check the parent key when links are loaded and set misses aside."),
    "CS07": Cause("The same parent is planned and weighed more than once.",
                  "A link was replaced at the source, but the old one was never deactivated here.",
                  "Set deleted links that are still active to stale.",
                  "Carry deletes over from the source and compare both sides daily."),
    "CS02": Cause("Durations turn negative and punctuality figures are wrong.",
                  "Start and end were most likely swapped when they were entered.",
                  "Clear the end date of the affected rows and mark them for review.",
                  "Reject rows whose end is before their start when they are loaded."),
    "RI01": Cause("Rows are missing from every report that filters by status.",
                  "A source uses its own status words and they were loaded untranslated.",
                  "Map the unknown status to the closest agreed one.",
                  "Keep a mapping table for status words and alert on new ones."),
    "RI05": Cause("Cost per unit and billing by amount are wrong for these rows.",
                  "Test or placeholder rows were loaded without a real amount.",
                  "Set the amount to NULL and mark the row for review.",
                  "Require a positive amount when rows are loaded."),
    "BIZ02": Cause("Business figures that divide by the amount are distorted.",
                   "The same rows as in the zero-amount rule.",
                   "Set the amount to NULL and mark the row for review.",
                   "Require a positive amount when rows are loaded."),
    "BIZ03": Cause("Re-planning costs money and makes punctuality hard to predict.",
                   "Superseded rows stay active after a change of plan.",
                   "Deactivate the superseded rows and mark them as resolved.",
                   "Deactivate the old row in the step that changes the plan."),
}
