from palimpsest.plans.scratch import Scratch, checkpoint_dir

__all__ = ["Scratch", "checkpoint_dir"]
