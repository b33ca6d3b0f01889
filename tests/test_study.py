from plumbline.plans.study import arms_of


def test_no_arm_is_dropped(spark):
    arms = [f"arm{i:03d}" for i in range(150)]
    assert arms_of(spark.createDataFrame([(a,) for a in arms * 2], "arm string")) == arms
